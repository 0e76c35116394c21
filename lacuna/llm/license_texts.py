"""Sentences by which licenses are known: a label and hand-written expressions over lower-case words.

Texts reach these rules as words of ASCII letters, digits and other characters with single spaces
between them, so hyphens, slashes and quotation marks are spaces here.
"""

# Wordings of public licenses' texts and of the notices that refer to them.
PERMISSIVE = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software",
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "(?:licensed|released|distributed|available|published) under (?:the )?mit",
        "mit licensed",
        "the mit license",
        "mit style licen[sc]e",
        "mit expat licen[sc]e",
        "expat license",
        "opensource org licenses mit",
    ),
    "mit-0": (
        "mit no attribution",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided",
    ),
    "x11": (
        "except as contained in this notice the names? of (?:the )?(?:x consortium|the above copyright holders?|copyright holders) shall not be used in advertising or otherwise to promote the sale use or other dealings in this software",
        "x consortium",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall (?:the author|isc) be liable for any special direct indirect or consequential damages",
        "(?:licensed|released|distributed) under (?:the )?isc",
    ),
    "hpnd": (
        "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted",
        "historical permission notice and disclaimer",
        "that both that copyright notice and this permission notice appear in supporting documentation",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd style licen[sc]e",
        "use of this source code is governed by a bsd style",
        "berkeley software distribution",
    ),
    "bsd-3-clause": (
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the names? of .{1,80}? nor the names of (?:its|their|any) contributors may be used to endorse or promote",
        "opensource org licenses bsd 3 clause",
    ),
    "bsd-2-clause": ("opensource org licenses bsd 2 clause", "freebsd (?:documentation )?license", "the views and conclusions contained in the software and documentation are those of the authors"),
    "bsd-4-clause": (
        "all advertising materials mentioning features or use of this software must display the following acknowledge?ments?",
        "this product includes software developed by the university of california berkeley and its contributors",
    ),
    "bsd-patent": ("bsd 2 clause plus patent",),
    "bsd-3-clause-clear": ("no express or implied licenses to any party s patent rights are granted by this license",),
    "bsd-3-clause-no-nuclear": ("you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility",),
    "0bsd": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "bsd zero clause"),
    "apache": (
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "apache org licenses",
        "apache style licen[sc]e",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "apache org licenses license 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
    ),
    "apache-1.1": ("this product includes software developed by the apache software foundation", "the names apache and apache software foundation must not be used to endorse"),
    "zlib": (
        "this software is provided as is without any express or implied warranty",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
    ),
    "libpng": ("the contributing authors and group 42 inc disclaim all warranties", "png reference library license", "libpng license"),
    "boost-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
        "distributed under the boost software license version 1 0",
        "boost org license 1 0 txt",
    ),
    "curl": ("curl license", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "ijg": ("this software is based in part on the work of the independent jpeg group", "independent jpeg group s software"),
    "freetype": ("portions of this software are copyright .{1,40}? the freetype project", "freetype (?:project )?license"),
    "icu": ("icu license", "copyright c .{1,40}? international business machines corporation and others all rights reserved permission is hereby granted"),
    "unicode": ("unicode license agreement", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files", "unicode inc license agreement data files and software"),
    "ncsa": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "university of illinois open source license"),
    "postgresql": ("in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", "postgresql global development group"),
    "openssl": (
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        "this product includes cryptographic software written by eric young",
        "the names openssl toolkit and openssl project must not be used to endorse",
    ),
    "ssleay": ("the licence and distribution terms for any publically available version or derivative of this code cannot be changed", "this package is an ssl implementation written by eric young"),
    "php": ("this product includes php software freely available from", "the php license version", "the name php must not be used to endorse or promote products"),
    "psf": (
        "python software foundation license (?:agreement|version)",
        "this license agreement is between the python software foundation psf and the individual or organization",
        "psf is making python available to licensee on an as is basis",
    ),
    "ruby": ("ruby is copyrighted free software by yukihiro matsumoto", "(?:distributed|licensed) under (?:the same terms as ruby|the ruby license)"),
    "perl": ("under the same terms as perl itself", "either the gnu general public license or the artistic license"),
    "w3c": (
        "w3c software notice and license",
        "this work and any related materials is being provided by the copyright holders under the following license",
        "notice of any changes or modifications to the w3c files including the date changes were made",
    ),
    "json": ("the software shall be used for good not evil",),
    "beerware": ("if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer ?ware"),
    "wtfpl": ("you just do what the fuck you want to", "do what the fuck you want to public licen[sc]e", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    "vim": ("vim is charityware", "there are no restrictions on distributing unmodified copies of vim"),
    "ntp": ("the university of delaware makes no representations about the suitability this software for any purpose", "ntp license"),
    "naist": ("nara institute of science and technology .{0,40}?all rights reserved",),
    "tcl": ("the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose",),
    "intel": ("intel open source license", "neither the name of (?:the )?intel corporation nor the names of its contributors"),
    "upl": ("subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "universal permissive license"),
    "blueoak-1.0.0": ("blue oak model license", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability"),
    "mulan-psl": ("mulan permissive software license", "license coscl org cn mulanpsl"),
    "afl": ("licensed under the academic free license", "academic free license"),
    "ecl": ("educational community license",),
    "ms-pl": ("microsoft public license", "if you distribute any portion of the software in source code form you may do so only under this license by including a complete copy of this license with your distribution"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "unlicense org",
    ),
    "public-domain": (
        "(?:released|placed|dedicated|put|is|are) (?:in|into|to) the public domain",
        "i (?:hereby )?(?:dedicate|place|release) (?:this (?:work|software|code)|any and all copyright interest in the software) (?:in|into|to) the public domain",
        "public domain dedication",
        "no copyright is claimed",
        "not subject to copyright protection",
        "a work of the united states government",
    ),
}
COPYLEFT = {
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this file is part of .{1,80}? is free software you can redistribute it and or modify",
        "you should have received a copy of the gnu general public license along with",
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "when we speak of free software we are referring to freedom not price",
        "gnu org (?:copyleft|licenses) gpl",
        "(?:distributed|licensed|released|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl",
        "gpl compatible",
    ),
    "gpl-2": ("gnu general public license version 2 june 1991", "gnu org licenses (?:old licenses )?gpl 2 0", "the precise terms and conditions for copying distribution and modification follow"),
    "gpl-3": ("gnu general public license version 3 29 june 2007", "gnu org licenses gpl 3 0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    "gpl-with-classpath-exception": ("linking this library statically or dynamically with other modules is making a combined work based on this library", "classpath exception"),
    "gpl-with-gcc-exception": ("gcc runtime library exception", "as a special exception if you link this library with files compiled with gcc"),
    "gpl-with-bison-exception": ("as a special exception you may create a larger work that contains part or all of the bison parser skeleton",),
    "gpl-with-autoconf-exception": ("as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf",),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
        "you should have received a copy of the gnu (?:lesser|library) general public license along with",
        "see the gnu (?:lesser|library) general public license for more details",
        "gnu org (?:copyleft|licenses) lgpl",
        "(?:distributed|licensed|released|available) under (?:the )?(?:terms of the )?(?:gnu )?lgpl",
    ),
    "lgpl-2.1": ("gnu lesser general public license version 2 1 february 1999", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    "lgpl-3": ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", "gnu org licenses lgpl 3 0"),
    "agpl": (
        "you should have received a copy of the gnu affero general public license along with",
        "see the gnu affero general public license for more details",
        "gnu org licenses agpl",
        "(?:distributed|licensed|released|available) under (?:the )?(?:gnu )?agpl",
    ),
    "agpl-3": ("gnu affero general public license version 3 19 november 2007", "specifically designed to ensure cooperation with the community in the case of network server software"),
    "gfdl": (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections no front cover texts and no back cover texts",
        "gnu org (?:copyleft|licenses) fdl",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "mozilla org mpl",
        "the contents of this file are subject to the mozilla public license",
    ),
    "mpl-2.0-no-copyleft-exception": ("this source code form is incompatible with secondary licenses as defined by the mozilla public license",),
    "npl": ("the contents of this file are subject to the netscape public license", "netscape public license"),
    "epl": (
        "the accompanying program is provided under the terms of this eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "eclipse org legal epl",
    ),
    "edl-1.0": ("eclipse distribution license",),
    "cpl": ("this program and the accompanying materials are made available under the terms of the common public license", "common public license"),
    "ipl": ("ibm public license",),
    "cddl": (
        "the contents of this file are subject to the terms of the common development and distribution license",
        "when distributing covered code include this cddl header in each file",
        "opensolaris license",
    ),
    "eupl": ("european union public licen[sc]e", "licensed under the eupl"),
    "cecill": ("governed by the cecill .{0,4}?license under french law", "cecill (?:b |c )?(?:free software )?license", "cecill info"),
    "osl": ("licensed under the open software license",),
    "artistic": (
        "the intent of this document is to state the conditions under which a package may be copied",
        "the clarified artistic license",
        "the artistic license",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the intent",
    ),
    "lppl": ("this work may be distributed and or modified under the conditions of the latex project public license", "latex project public license", "this work has the lppl maintenance status"),
    "ofl": (
        "this font software is licensed under the sil open font license",
        "sil open font license",
        "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself",
        "scripts sil org ofl",
    ),
    "gust-font": ("gust font license",),
    "bitstream-vera": ("permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license",),
    "ubuntu-font": ("ubuntu font licen[sc]e",),
    "qpl": ("q public license", "the qt free edition"),
    "sleepycat": ("redistributions in any form must be accompanied by information on how to obtain complete source code", "sleepycat (?:software )?license"),
    "apsl": ("apple public source license",),
    "cpal-1.0": ("common public attribution license",),
    "rpl": ("reciprocal public license",),
    "zpl": ("zope public license", "this software is subject to the provisions of the zope public license"),
    "ms-rl": ("microsoft reciprocal license",),
    "sspl-1.0": ("server side public license", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    "oldap": ("the openldap public license", "openldap public license"),
    "watcom": ("sybase open watcom public license",),
    "spl": ("sun public license",),
    "sissl": ("sun industry standards source license",),
    "rpsl": ("realnetworks public source license",),
    "motosoto": ("motosoto open source license",),
    "ngpl": ("nethack general public licen[sc]e",),
}
CONTENT = {
    "cc": (
        "this work is licensed under (?:a |the )?creative commons",
        "creativecommons org licenses",
        "some rights reserved",
        "(?:licensed|released|available|published) under (?:a |the )?creative commons",
        "creative commons legal code",
    ),
    "cc-by": ("creative commons attribution", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    "cc-by-sa": ("if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "text is available under the creative commons attribution share ?alike"),
    "cc-by-nc": ("you may not use the material for commercial purposes", "for non ?commercial (?:use|purposes) only under (?:a |the )?creative commons"),
    "cc-by-nd": ("if you remix transform or build upon the material you may not distribute the modified material",),
    "cc0": (
        "creativecommons org publicdomain zero",
        "to the extent possible under law .{1,60}? (?:has|have) waived all copyright and related or neighboring rights",
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "cc0 1 0 universal",
        "no rights reserved",
    ),
    "cc-pdm": ("creativecommons org publicdomain mark", "this work has been identified as being free of known restrictions under copyright law"),
    "odbl": ("open data commons open database license", "opendatacommons org licenses odbl", "this .{1,60}? is made available under the open database license"),
    "odc-by": ("open data commons attribution license", "opendatacommons org licenses by"),
    "pddl": ("open data commons public domain dedication", "public domain dedication and license"),
    "ogl-uk": ("open government licen[sc]e", "contains public sector information licensed under"),
    "etalab": ("licence ouverte", "etalab"),
    "dl-de": ("datenlizenz deutschland",),
    "cdla": ("community data license agreement",),
    "free-art": ("free art license", "licence art libre"),
    "opl": ("open publication license", "open content license"),
    "oasis": ("oasis open all rights reserved",),
    "ietf": ("this document is subject to bcp 78 and the ietf trust s legal provisions",),
    "gutenberg": ("project gutenberg (?:tm )?license", "this e ?book is for the use of anyone anywhere .{0,60}?at no cost and with almost no restrictions whatsoever"),
    "rail": ("open ?rail(?: m)? license", "responsible ai license", "use restrictions you agree not to use the model"),
    "llama": ("llama (?:2 |3 )?community license agreement", "meta llama .{0,20}?is licensed under"),
    "gemma": ("gemma terms of use",),
}
RESTRICTED = {
    "all-rights-reserved": ("all rights reserved", "alle rechte vorbehalten", "tous droits r[ée]serv[ée]s", "todos los derechos reservados", "tutti i diritti riservati"),
    "proprietary": (
        "proprietary and confidential",
        "unauthorized (?:copying|use|reproduction|distribution) .{0,60}?is strictly prohibited",
        "this (?:software|document|file) is (?:the )?(?:confidential and )?proprietary (?:information|property) of",
        "no part of this (?:publication|document|book|software|work) may be reproduced",
        "may not be copied reproduced .{0,40}?without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)",
        "(?:unpublished|trade) secrets? of",
        "licensed not sold",
    ),
    "eula": ("end user license agreement", "by (?:installing|downloading|using|clicking) .{0,60}?you (?:agree|accept) (?:to be bound by )?(?:to )?the terms of this (?:license|agreement|eula)", "you may not reverse engineer decompile or disassemble"),
    "busl-1.1": ("business source license", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    "elastic-2.0": ("elastic license", "you may not provide the software to third parties as a hosted or managed service"),
    "commons-clause": ("commons clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    "confluent": ("confluent community license",),
    "polyform": ("polyform (?:noncommercial|strict|shield|small business|internal use|free trial) license",),
    "fsl": ("functional source license",),
    "prosperity": ("prosperity public license",),
    "non-commercial": ("for non ?commercial (?:use|purposes) only", "not for commercial use", "free for (?:personal|non ?commercial|academic|research) use", "(?:academic|research|educational|evaluation) use only"),
    "redistribution-forbidden": ("redistribution is (?:not permitted|prohibited|forbidden)", "do not (?:re)?distribute", "not (?:be )?for redistribution"),
    "shareware": ("this is shareware", "shareware version", "freeware"),
    "terms-of-use": ("terms of (?:use|service) apply", "subject to (?:the|our) terms of (?:use|service)"),
    "hippocratic": ("hippocratic license",),
    "anti-996": ("anti 996 license", "996 icu"),
    "adobe": ("adobe systems incorporated .{0,40}?all rights reserved", "adobe glyph list license"),
    "nvidia": ("nvidia (?:corporation and its licensors retain all intellectual property|software license agreement)",),
    "microsoft": ("microsoft software license terms", "microsoft limited public license"),
    "oracle": ("oracle (?:binary code|technology network) license agreement",),
}
TEXTS = [(label, text) for group in (PERMISSIVE, COPYLEFT, CONTENT, RESTRICTED) for label, texts in group.items() for text in texts]
