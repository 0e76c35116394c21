"""The pipeline's stages against brute-force versions of their decisions."""

import re
from collections import defaultdict

import corpus_pipeline
from lacuna.llm import langid, quality
from lacuna.llm.entry import queries

from .test_jaccard import brute, edited, text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that it was for on as with be by at he this are from"
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch"


def prose(r, stops, n):
    ws = stops.split()
    return " ".join(r.choice(ws) if r.random() < 0.4 else "".join(r.choice("abcdefghilmnoprst") for _ in range(r.randint(3, 9))) for _ in range(n))


def corpus():
    import random

    r, rows = random.Random(5), []
    for k in range(120):
        lang, stops = ("en", EN) if k % 3 else ("de", DE)
        rows.append((prose(r, stops, r.randint(60, 160)), lang, f"s{k % 4}"))
    rows += [(edited(r, t, 1), lang, s) for t, lang, s in rows[:30]]
    rows += [("1234 !! 99", "en", "s1"), (None, "en", "s2"), ("", None, None), ("the | of | " * 40, "en", "s0"), (text(r, 80), "en", "s1")]
    return [(k, t, lang, s, len(t or "")) for k, (t, lang, s) in enumerate(rows)]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)

    model = langid.train(docs)
    named = stage["language_id"](spark, docs, "").collect()
    verdict = langid.identify(model, [x[1] for x in rows])
    want = sorted(x[0] for x, v in zip(rows, verdict) if v[0] != langid.UNKNOWN and v[1] >= corpus_pipeline.MIN_LANGUAGE_SHARE)
    assert sorted(r.doc_id for r in named) == want and {120 + 30, 151, 152}.isdisjoint(want)

    docs = spark.createDataFrame(named, COLUMNS)
    good = stage["quality_rules"](spark, docs, "").collect()
    stops = set(quality.ALL_STOP_WORDS)

    def passes(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        return len(ws) >= 50 and 50 * sum(w.lower() in stops for w in ws) >= len(ws) and not re.search(r"[|]", t)

    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in named if passes(r.text))

    docs = spark.createDataFrame(good, COLUMNS)
    single = stage["jaccard_join"](spark, docs, "").collect()
    classes = brute([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted({c for _, c, _ in classes}) and len(single) < len(good)

    docs = spark.createDataFrame(single, COLUMNS)
    mixed = stage["source_mix"](spark, docs, "")
    assert mixed.columns == docs.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert set(times) <= {r.doc_id for r in single} and max(times.values()) <= 3

    ids = stage["piece_sampling"](spark, mixed, "").collect()
    import zlib

    texts = {r.doc_id: r.text for r in single}
    assert sorted((r.doc_id, r.text_crc32) for r in ids) == sorted((k, zlib.crc32(texts[k].encode())) for k, n in times.items() for _ in range(n))


def test_clashing_columns(spark):
    """Columns named like the stages' own come out as they went in."""
    names = ["language", "quality", "rep", "node", "size", "keep_id", "_id", "_row", "k_doc", "K_TIMES", "k_turn", "at", "rank", "piece_ids", "_key", "_text", "h", "bucket", "n"]
    docs = spark.createDataFrame(corpus()[:60] + corpus()[120:130], COLUMNS).selectExpr("*", *[f"concat('v', doc_id) AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) > 10 and all(r[n] == f"v{r.doc_id}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    from lacuna.llm.entry import tokenizer_path
    from lacuna.llm.pieces import encode

    out = encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded="n")
    assert set(out.columns) == set(docs.columns) and out.filter("n <> text").count() == 0


def test_null_and_repeated_ids(spark):
    """Texts that share a doc_id, or have none, are documents of their own; one of each group stays."""
    import random

    r = random.Random(6)
    texts = [prose(r, EN, 90) for _ in range(12)]
    rows = [(7, t, "en", "s0", len(t)) for t in texts[:4]] + [(None, t, "en", "s1", len(t)) for t in texts[4:8]] + [(k, t, "en", "s2", len(t)) for k, t in enumerate(texts[8:])]
    rows += [(None, texts[0], "en", "s0", 1), (7, texts[5], "en", None, 2), (90, edited(r, texts[9], 1), "en", "s2", 3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    single = stage["jaccard_join"](spark, docs, "")
    kept = single.collect()
    assert len(kept) == 12 and single.columns == docs.columns
    assert len(stage["language_id"](spark, docs, "").collect()) == len(stage["quality_rules"](spark, docs, "").collect()) == len(rows)
    mixed = stage["source_mix"](spark, single, "").collect()
    assert {r.text for r in mixed} <= {r.text for r in kept}
    assert stage["piece_sampling"](spark, single, "").count() == 12


def test_very_long_texts(spark):
    import random

    r = random.Random(7)
    long = prose(r, EN, 60_000)
    rows = [(1, long, "en", "s0", 1), (2, edited(r, long, 5), "en", "s0", 1), (3, prose(r, EN, 40_000), "en", "s1", 1)] + [(k, prose(r, EN, 80), "en", "s1", 1) for k in range(4, 40)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), COLUMNS)
    assert {x.doc_id for x in docs.collect()} >= {1, 3} and 2 not in {x.doc_id for x in docs.collect()}
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {x.doc_id for x in ids} == {x.doc_id for x in docs.collect()}


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(corpus()[:40], COLUMNS).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 5
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in queries()} == set(range(1, 11))
