"""Signatures of licence texts and notices: (label, keyword, pattern), one line each.

Patterns are over words: lower case, one space between, all marks dropped ("author's" is "author s"). A rule is tried only on
texts that hold its keyword. Fixed values: the sentences are those of the licences.
"""

SIGNATURES: list[tuple[str, str, str]] = [
    # Permissive
    ("mit", "hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "hereby granted free of charge", r"permission is hereby granted free of charge"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("mit", "x11", r"(?:the )?x11 licen[sc]e"),
    ("isc", "with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause", r"(?:bsd )?zero clause(?: bsd)?(?: licen[sc]e)?"),
    ("bsd", "source and binary forms", r"redistributions? and use in source and binary forms(?: with or without modification)?(?: are permitted)?(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:[^ ]+ ){1,20}nor the names of (?:[^ ]+ ){1,8}may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse or promote", r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-4-clause", "this product includes", r"this product includes software developed by the university of california"),
    ("apache-2.0", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed under the license", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache group", r"this product includes software developed by the apache group"),
    ("apache-2.0", "each contributor", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "express or implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("boost-1.0", "person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("hpnd", "its documentation", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: is hereby granted without fee)?"),
    ("postgresql", "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "ncsa open source", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", "beer", r"(?:the )?beer ?ware licen[sc]e"),
    ("wtfpl", "want to", r"you just do what the fuck you want to"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: version 2)?"),
    ("ijg", "jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("unicode", "unicode", r"unicode(?: inc)? licen[sc]e(?: agreement)?(?: data files and software)?"),
    ("w3c", "w3c", r"w3c (?:software (?:and document )?)?(?:notice and )?licen[sc]e"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project(?: for use in the openssl toolkit)?"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php", "php software", r"this product includes php software freely available from"),
    ("python", "python software foundation", r"this licen[sc]e agreement is between the python software foundation"),
    ("python", "beopen", r"beopen python open source licen[sc]e agreement"),
    ("python", "cnri", r"cnri open source (?:gpl compatible )?licen[sc]e agreement"),
    ("tcl", "tcl", r"tcl tk licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("afl", "academic free", r"academic free licen[sc]e(?: (?:version|v) ?[123] [01])?"),
    ("ecl", "educational community", r"educational community licen[sc]e(?: version [12] 0)?"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e(?: (?:version )?1 0)?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)(?: ?v?[12])?"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("anti-996", "anti 996", r"anti 996 licen[sc]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
    ("fsul", "freebsd", r"freebsd (?:documentation )?licen[sc]e"),
    ("sgi-b", "sgi", r"sgi free software licen[sc]e b"),
    ("fair", "fair licen", r"(?:the )?fair licen[sc]e usage of the works is permitted"),
    # Public domain
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("cc0-1.0", "neighboring rights", r"has (?:waived|dedicated) all copyright and (?:all )?related or neighboring rights"),
    ("cc0-1.0", "universal", r"cc0 1 0 universal(?: public domain dedication)?"),
    ("public-domain", "public domain", r"(?:is|are|has been|have been) (?:hereby )?(?:placed|put|released) (?:in|into) the public domain"),
    ("public-domain", "public domain", r"(?:this (?:work|file|software|code|document|text) is )?(?:in|dedicated to|belongs to) the public domain"),
    ("public-domain", "disclaims", r"the author disclaims copyright to this source code"),
    ("blessing", "in place of a legal notice", r"in place of a legal notice here is a blessing"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    # Copyleft
    ("gpl", "is free software", r"this (?:program|file|script|code|software|package) is free software(?: and)? you can redistribute it(?: and or modify it under the terms of the gnu general public licen[sc]e)?"),
    ("gpl-1.0-or-later", "either version 1", r"gnu general public licen[sc]e as published by the free software foundation either version 1(?: of the licen[sc]e)? or at your option any later version"),
    ("gpl-2.0-or-later", "either version 2", r"gnu general public licen[sc]e as published by the free software foundation either version 2(?: of the licen[sc]e)? or at your option any later version"),
    ("gpl-3.0-or-later", "either version 3", r"gnu general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)? or at your option any later version"),
    ("gpl-2.0-only", "version 2 as published", r"gnu general public licen[sc]e version 2 as published by the free software foundation"),
    ("gpl-3.0-only", "version 3 as published", r"gnu general public licen[sc]e version 3 as published by the free software foundation"),
    ("gpl", "received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "is a free copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software"),
    ("lgpl", "library is free software", r"this library is free software(?: and)? you can redistribute it(?: and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e)?"),
    ("lgpl-2.1-or-later", "version 2 1", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1(?: of the licen[sc]e)? or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser general", r"gnu lesser general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)? or at your option any later version"),
    ("lgpl", "received a copy of the gnu l", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-3.0-or-later", "affero", r"gnu affero general public licen[sc]e as published by the free software foundation either version 3(?: of the licen[sc]e)? or at your option any later version"),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "this document under", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-exception", "classpath", r"(?:with )?(?:the )?classpath exception"),
    ("gpl-exception", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-exception", "special exception", r"as a special exception (?:[^ ]+ ){1,12}permission to link"),
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e(?: v 2 0)?"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0-no-copyleft", "incompatible with secondary", r"this source code form is incompatible with secondary licenses"),
    ("npl", "netscape", r"netscape public licen[sc]e(?: version 1 [01])?"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[sc]e"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: (?:version |v )?1 0)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e(?: version 1 0)?"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("spl", "sun public", r"sun public licen[sc]e(?: version 1 0)?"),
    ("osl", "open software licen", r"open software licen[sc]e(?: (?:version|v) ?[123] [01])?"),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e(?: 1 [15])?"),
    ("apsl", "apple public", r"apple public source licen[sc]e(?: version [12] [012])?"),
    ("qpl", "q public", r"q public licen[sc]e(?: version 1 0)?"),
    ("sleepycat", "sleepycat", r"sleepycat (?:software|licen[sc]e)"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software)?(?: licen[sc]e(?: agreement)?)?(?: v ?[12](?: [01])?)?"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version)?(?: 1 [12])?"),
    ("lppl", "latex project", r"(?:under the conditions of the )?latex project public licen[sc]e"),
    ("artistic", "package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", "same terms as perl", r"under the same terms as perl(?: ?5)? itself"),
    ("ruby", "ruby", r"(?:the )?ruby licen[sc]e"),
    ("ofl", "fonts and derivatives", r"the fonts and derivatives however cannot be released under any other type of licen[sc]e"),
    ("ofl", "font software", r"this font software is licensed under the sil open font licen[sc]e"),
    ("sspl-1.0", "server side public", r"server side public licen[sc]e(?: (?:version |v ?)?1)?"),
    # Works and data
    ("cc", "creative commons", r"this work is licensed under (?:a |the )?creative commons"),
    ("cc", "creative commons", r"(?:some rights reserved )?creative commons licen[sc]e"),
    ("odbl", "open database", r"made available under the open database licen[sc]e"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e(?: v ?1 0)?"),
    ("cdla", "community data", r"community data licen[sc]e agreement(?: (?:permissive|sharing))?(?: (?:version )?[12] 0)?"),
    ("ogl-uk", "open government", r"open government licen[sc]e(?: v ?[123](?: 0)?)?"),
    ("fal", "free art", r"free art licen[sc]e(?: 1 [23])?"),
    ("gutenberg", "gutenberg", r"(?:the )?(?:full )?project gutenberg (?:tm )?licen[sc]e"),
    ("openstreetmap", "openstreetmap", r"openstreetmap contributors"),
    # Source available and models
    ("busl-1.1", "business source", r"business source licen[sc]e(?: (?:version )?1 1)?"),
    ("commons-clause", "commons clause", r"(?:the )?commons clause(?: licen[sc]e condition)?"),
    ("commons-clause", "right to sell", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software"),
    ("elastic-2.0", "elastic licen", r"elastic licen[sc]e(?: 2 0| v2)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial)(?: licen[sc]e)?(?: 1 0 [01])?"),
    ("openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama ?[234]?(?: [0-9])? community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("fsl", "functional source", r"functional source licen[sc]e"),
    # Proprietary
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("proprietary", "strictly prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} is strictly prohibited"),
    ("proprietary", "without the prior written", r"(?:may not|must not|cannot) be (?:reproduced|copied|distributed|disclosed)(?: [^ ]+){0,12} without the prior written (?:permission|consent)"),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:valuable )?(?:proprietary information and )?trade secrets?"),
    ("proprietary", "end user licen", r"end user licen[sc]e agreement"),
    ("proprietary", "internal use only", r"for internal use only"),
    ("proprietary", "distribution", r"not for (?:re)?distribution"),
    ("proprietary", "commercial licen", r"(?:a )?commercial licen[sc]e (?:is required|must be (?:purchased|obtained))"),
    ("noncommercial", "commercial", r"(?:free )?for (?:personal and |academic and |research and )?non ?commercial (?:use|purposes) only"),
    ("research-only", "research purposes only", r"for (?:academic |scientific )?research purposes only"),
]
