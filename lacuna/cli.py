"""Command line: compare the elements of two genomes.

    python -m lacuna.cli SYNTENY ELEMENTS1 ELEMENTS2 [GENOME1] [GENOME2] [-o PREFIX] [-v]
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators.preview import ELEMENT_ROWS, SYNTENY_ROWS, element_preview, synteny_preview
from .plans.compare import compare
from .sources import detect_format, file_exists, numbered_lines, rejects
from .sources.annotations import PARSERS, synteny
from .sources.report import counts_text, summary_lines, write_report

log = logging.getLogger("lacuna")
USAGE = __doc__.strip() + """

  SYNTENY              blocks of both genomes, tab-separated
  ELEMENTS1, 2         annotations of either genome, GFF3 or BED
  GENOME1, 2           sequence files, reserved for later use
  -o, --output PREFIX  prefix of the reports (default: te_comparison)
  -v, --verbose        show the first rows of every relation
  -h, --help           show this text
"""


@dataclass
class Arguments:
    synteny: str = ""
    te1: str = ""
    te2: str = ""
    genome1: str | None = None
    genome2: str | None = None
    prefix: str = "te_comparison"
    verbose: bool = False
    help: bool = False


class UsageError(Exception):
    pass


def parse_arguments(argv: list[str]) -> Arguments:
    """Help anywhere wins; the first three arguments are files whatever they look like; then up to
    two more files, then options."""
    if "-h" in argv or "--help" in argv:
        return Arguments(help=True)
    if len(argv) < 3:
        raise UsageError("")
    out, rest = Arguments(*argv[:3]), list(argv[3:])
    for name in ("genome1", "genome2"):
        if rest and not rest[0].startswith("-"):
            setattr(out, name, rest.pop(0))
    while rest:
        option = rest.pop(0)
        if option in ("-v", "--verbose"):
            out.verbose = True
        elif option in ("-o", "--output") and rest:
            out.prefix = rest.pop(0)
        else:
            raise UsageError(f"Error: Unknown option {option}")
    return out


def _warn_rejects(lines: DataFrame, form: str) -> None:
    for r in rejects(lines, form).orderBy("line_no").toLocalIterator():
        log.warning("Warning: Line %d has insufficient columns (%d), skipping", r["line_no"], r["n_tokens"])


def _show(title: str, what: str, count: int, rows: int, head: DataFrame, names: str) -> None:
    print(f"\n=== {title} ===\nTotal {what}: {count}")
    if count:
        print(f"First {rows} {'blocks' if 'block' in what else what}:\n{names}")
        for r in head.collect():
            print("\t".join(f"{x:.2f}" if isinstance(x, float) else str(x) for x in r))
    print()


def run(spark: SparkSession, args: Arguments) -> int:
    """The whole comparison; the exit code."""
    # The messages of this command, here, in _show and in _warn_rejects.
    for what, path in (("Synteny file", args.synteny), ("TE file 1", args.te1), ("TE file 2", args.te2)):
        if not file_exists(spark, path):
            log.error("Error: %s not found: %s", what, path)
            return 1
    for g, path in ((1, args.genome1), (2, args.genome2)):
        if path and not file_exists(spark, path):
            log.warning("Warning: Genome %d file not found: %s", g, path)
    print(f"=== Lacuna ===\nSynteny file: {args.synteny}\nTE file 1: {args.te1}\nTE file 2: {args.te2}")
    for g, path in ((1, args.genome1), (2, args.genome2)):
        if path:
            print(f"Genome {g} file: {path}")
    print(f"Output prefix: {args.prefix}\nVerbose mode: {'ON' if args.verbose else 'OFF'}\n")

    blocks = _load(spark, args.synteny, "synteny")
    print(f"Parsed {blocks.count()} synteny blocks from {args.synteny}")
    elements = []
    for g, path in ((1, args.te1), (2, args.te2)):
        form = detect_format(spark, path)
        if form is None:
            log.error("Error: Unsupported file format for TE file %d: %s", g, path)
            return 1
        elements.append(_load(spark, path, form))
        print(f"Parsed {elements[-1].count()} transposons from {form.upper()} file {path}")

    c = compare(*elements, blocks)
    uniques = [c.unique1.persist(), c.unique2.persist()]  # each feeds counts, previews and a report
    s = c.summary.first()
    if args.verbose:
        _show("Synteny Blocks", "synteny blocks", s["synteny"], SYNTENY_ROWS, synteny_preview(blocks), "Chr1\tStart1\tEnd1\tChr2\tStart2\tEnd2\tScore")
        for title, df, n in (("Genome 1 TEs", elements[0], s["te1"]), ("Genome 2 TEs", elements[1], s["te2"])):
            _show(title, "transposons", n, ELEMENT_ROWS, element_preview(df), "ID\tChr\tStart\tEnd\tStrand\tType\tFamily")
    print("Comparing TE differences between two genomes...")
    print("\n".join(summary_lines(s)))
    for title, what, key, frames in (("Transposon Type Analysis", "types", "type", (c.types1, c.types2)), ("Transposon Family Analysis", "families", "family", (c.families1, c.families2))):
        print(counts_text(title, [(g, what, [(r[key], r["n"]) for r in f.collect()]) for g, f in enumerate(frames, 1)]))
    if args.verbose:
        for g, u in enumerate(uniques, 1):
            _show(f"Genome {g} Unique TEs", "transposons", s[f"unique{g}"], ELEMENT_ROWS, element_preview(u), "ID\tChr\tStart\tEnd\tStrand\tType\tFamily")
    for g, u in enumerate(uniques, 1):
        try:
            print(f"Genome {g} unique TEs written to: {write_report(u, args.prefix, g)}")
        except OSError as e:
            log.error("Error: Cannot write the report of genome %d: %s", g, e)
            return 1
    print(f"\n=== Analysis Complete ===\nTotal unique transposons identified: {s['total_unique']}\nResults written to files with prefix: {args.prefix}")
    return 0


def _load(spark: SparkSession, path: str, form: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    _warn_rejects(lines, form)
    return (synteny if form == "synteny" else PARSERS[form])(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=logging.WARNING, format="%(message)s", stream=sys.stderr)
    try:
        args = parse_arguments(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"{e}\n{USAGE}".lstrip(), file=sys.stderr)
        return 1
    if args.help:
        print(USAGE)
        return 0
    return run(spark or SparkSession.builder.appName("lacuna").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
