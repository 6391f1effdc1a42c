"""License scans: ordered signature rules behind a keyword prefilter.

Every rule is (priority, label, keyword, regex). A text is searched by a rule only if the rule's
keyword occurs in it; one Aho-Corasick pass finds which keywords do. Both read the text with line
breaks, comment prefixes and runs of white space as one blank, since license texts are wrapped. Detections are intervals;
they are visited by (priority, start, longest, rule order) and one that lies inside an interval
already kept is suppressed.

Null text counts as empty. A text without detections has zero counts, null word positions, empty
label strings and score 0. Ties resolve by rule order. Rows are independent, so repeated rows
repeat their result and an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import common

#: Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
SEP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_EDGE_L, _EDGE_R = r"(?<![^\x00-\x2f\x3a-\x60\x7b-\x7f])", r"(?![^\x00-\x2f\x3a-\x60\x7b-\x7f])"

#: Label, keyword, regex of the license's own name (lower case).
NAMES = (
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e,?(?: version)? 1\.0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e,?(?: version)? 1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e,?\s*(?:\(?version|v\.?)?\s*2(?:\.0)?"),
    ("mit", "mit", r"mit(?:/x11| expat)? licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("gpl-1.0", "general public", r"gnu general public licen[sc]e,?(?: as published by the free software foundation[;,]?)?(?: either)?(?: version| v)\.? ?1(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e,?(?: as published by the free software foundation[;,]?)?(?: either)?(?: version| v)\.? ?2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e,?(?: as published by the free software foundation[;,]?)?(?: either)?(?: version| v)\.? ?3(?:\.0)?"),
    ("lgpl-2.0", "library general", r"gnu library general public licen[sc]e"),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public licen[sc]e,?(?: version| v)\.? ?2\.1"),
    ("lgpl-3.0", "lesser general", r"gnu lesser general public licen[sc]e,?(?: version| v)\.? ?3(?:\.0)?"),
    ("lgpl", "lesser general", r"gnu lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?:,? (?:version|v)\.? ?3(?:\.0)?)?"),
    ("fdl-1.3", "documentation", r"gnu free documentation licen[sc]e(?:,? version 1\.[123])?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2[- ]clause)(?: \"?simplified\"?)? licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3[- ]clause)(?: \"?(?:new|revised)\"?)* licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4[- ]clause) licen[sc]e"),
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|bsd zero[- ]clause|0bsd) licen[sc]e"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,?(?: version| v)\.? ?1\.[01]"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e,?(?: version| v)\.? ?2(?:\.0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?:,? -?(?: version| v)\.? ?1(?:\.0)?)"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?:,? -?(?: version| v)\.? ?2(?:\.0)?)"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e(?: \(cddl\))?"),
    ("cpl-1.0", "common", r"common public licen[sc]e"),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e"),
    ("eupl-1.2", "european", r"european union public licen[sc]e"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?:,? (?:version )?[12]\.0)?"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e"),
    ("busl-1.1", "business", r"business source licen[sc]e"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("python-2.0", "python", r"python (?:software foundation )?licen[sc]e"),
    ("php-3.01", "php", r"php licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", "illinois", r"(?:university of illinois/)?ncsa open source licen[sc]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("afl-3.0", "academic", r"academic free licen[sc]e"),
    ("osl-3.0", "open software", r"open software licen[sc]e"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense\b"),
    ("wtfpl", "what the", r"do what the f\S+ you want to public licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]1\.0)?(?: universal)?"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution(?: \d\.\d)?(?: international)? licen[sc]e"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution[- ]share-?alike(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution[- ]non-?commercial(?: \d\.\d)?(?: international)?(?: licen[sc]e)?"),
    ("cc-by-nd-4.0", "creative commons", r"creative commons attribution[- ]no-?deriv(?:s|atives)(?: \d\.\d)?(?: licen[sc]e)?"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[sc]e"),
    ("cecill-2.1", "cecill", r"cecill(?:-[bc])? licen[sc]e"),
    ("lppl-1.3c", "latex", r"latex project public licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("cc-by-nc-sa-4.0", "commons", r"creative commons attribution[- ]non-?commercial[- ]share-?alike(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd-4.0", "commons", r"creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:s|atives)(?: \d\.\d)?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-3.0", "commons", r"creative commons attribution 3\.0(?: unported)?(?: licen[sc]e)?"),
    ("cc-pddc", "commons", r"creative commons public domain dedication"),
    ("mit-modern-variant", "mit", r"modern mit licen[sc]e"),
    ("blueoak-1.0.0", "blue", r"blue oak model licen[sc]e(?: 1\.0\.0)?"),
    ("apsl-2.0", "apple", r"apple public source licen[sc]e(?:,? version 2\.0)?"),
    ("rpl-1.5", "reciprocal", r"reciprocal public licen[sc]e"),
    ("qpl-1.0", "public", r"q public licen[sc]e"),
    ("spl-1.0", "sun", r"sun public licen[sc]e"),
    ("sissl", "sun", r"sun industry standards source licen[sc]e"),
    ("bcl", "binary", r"(?:oracle|sun) binary code licen[sc]e(?: agreement)?"),
    ("otn", "oracle", r"oracle technology network licen[sc]e(?: agreement)?"),
    ("nasa-1.3", "nasa open source", r"nasa open source agreement"),
    ("npl-1.1", "netscape", r"netscape public licen[sc]e"),
    ("nposl-3.0", "non-profit", r"non-profit open software licen[sc]e"),
    ("intel", "intel", r"intel open source licen[sc]e"),
    ("lpl-1.02", "lucent", r"lucent public licen[sc]e"),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software licen[sc]e(?:,? version 2)?"),
    ("osgi", "osgi", r"osgi specification licen[sc]e"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?:,? version 2\.0)?"),
    ("eudatagrid", "datagrid", r"eu datagrid software licen[sc]e"),
    ("fair", "fair", r"(?:the )?fair licen[sc]e"),
    ("entessa", "entessa", r"entessa public licen[sc]e"),
    ("frameworx-1.0", "frameworx", r"frameworx open licen[sc]e"),
    ("catosl-1.1", "trusted", r"computer associates trusted open source licen[sc]e"),
    ("cua-opl-1.0", "cua", r"cua office public licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("nokia", "nokia", r"nokia open source licen[sc]e"),
    ("oclc-2.0", "oclc", r"oclc research public licen[sc]e"),
    ("ogtsl", "open group", r"open group test suite licen[sc]e"),
    ("rscpl", "ricoh", r"ricoh source code public licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("vsl-1.0", "vovida", r"vovida software licen[sc]e"),
    ("watcom-1.0", "watcom", r"sybase open watcom public licen[sc]e"),
    ("xnet", "x.net", r"x\.net licen[sc]e"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("ipa", "ipa", r"ipa font licen[sc]e"),
    ("lal-1.3", "art l", r"(?:licence art libre|free art licen[sc]e)"),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "commons", r"open data commons public domain dedication(?: and licen[sc]e)?"),
    ("ogl-uk-3.0", "government", r"open government licen[sc]e(?: v?\d\.0)?"),
    ("etalab-2.0", "licence ouverte", r"licence ouverte(?: v?2\.0)?"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland[- –]*(?:namensnennung)?"),
    ("cdla-permissive-2.0", "community data", r"community data licen[sc]e agreement[- –]*permissive"),
    ("cdla-sharing-1.0", "community data", r"community data licen[sc]e agreement[- –]*sharing"),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform noncommercial licen[sc]e"),
    ("polyform-small-business-1.0.0", "polyform", r"polyform small business licen[sc]e"),
    ("commons-clause", "commons clause", r"commons clause licen[sc]e condition"),
    ("parity-7.0.0", "parity", r"parity public licen[sc]e"),
    ("hippocratic-2.1", "hippocratic", r"hippocratic licen[sc]e"),
    ("jpnic", "jpnic", r"jpnic licen[sc]e"),
    ("bittorrent-1.1", "bittorrent", r"bittorrent open source licen[sc]e"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?:\+\+)?-m licen[sc]e"),
    ("llama-community", "llama", r"llama \d(?:\.\d)? community licen[sc]e(?: agreement)?"),
    ("bigscience-rail-1.0", "bigscience", r"bigscience (?:open )?rail licen[sc]e"),
    ("opl-1.0", "open publication", r"open publication licen[sc]e"),
    ("opencontent", "opencontent", r"opencontent licen[sc]e"),
    ("gfdl-invariant", "no invariant", r"with no invariant sections"),
    ("beerware", "beer", r"(?:the )?beer-?ware licen[sc]e"),
    ("json", "json", r"(?:the )?json licen[sc]e"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("unicode-3.0", "unicode", r"unicode(?:, inc\.)? licen[sc]e(?: agreement| v3)?"),
    ("bzip2-1.0.6", "bzip2", r"bzip2 licen[sc]e"),
    ("ftl", "freetype", r"freetype (?:project )?licen[sc]e"),
    ("ijg", "jpeg", r"independent jpeg group licen[sc]e"),
    ("tcl", "tcl", r"tcl/?tk licen[sc]e"),
    ("info-zip", "info-zip", r"info-?zip licen[sc]e"),
    ("perl", "terms as perl", r"same terms as perl(?: itself)?"),
)

#: Passages that mark one license's own text; label, keyword, regex.
PASSAGES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "software is provided", r"the software is provided \"?as is\"?, without warranty of any kind"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose"),
    ("bsd-2-clause", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of (?:its|their) contributors"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl-3.0-or-later", "or (at your option)", r"either version 3 of the licen[sc]e, or \(at your option\) any later version"),
    ("gpl-2.0-or-later", "or (at your option)", r"either version 2 of the licen[sc]e, or \(at your option\) any later version"),
    ("gpl", "free software", r"this program is free software[:;,] you can redistribute it and/?(?:or)? modify"),
    ("gpl", "gnu.org/licenses", r"https?://(?:www\.)?gnu\.org/licenses"),
    ("mpl-2.0", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("zlib", "express or implied", r"this software is provided 'as-is', without any express or implied warranty"),
    ("bsl-1.0", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person or organization"),
    ("cc-by", "creativecommons.org", r"https?://creativecommons\.org/licenses/by/\d\.\d"),
    ("cc-by-sa", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/\d\.\d"),
    ("cc-by-nc", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc(?:-sa|-nd)?/\d\.\d"),
    ("cc0-1.0", "creativecommons.org", r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("all-rights-reserved", "all rights reserved", r"copyright .{0,80}?all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("mit", "copyright notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies"),
    ("mit", "event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("mit", "merge", r"without limitation the rights to use, copy, modify, merge, publish, distribute, sublicen[sc]e,? and/?(?:or)? sell"),
    ("mit-0", "granted, free of charge", r"granted, free of charge, to any person obtaining a copy of this software .{0,300}?to whom the software is furnished to do so\. the software"),
    ("x11", "not be used in advertising", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software"),
    ("isc", "without fee", r"for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("0bsd", "without fee", r"for any purpose with or without fee is hereby granted\. the software is provided"),
    ("bsd", "bsd-style", r"governed by a bsd-style licen[sc]e that can be found in"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "following acknowledg", r"must display the following acknowledge?ment: this product includes software developed by"),
    ("bsd", "express or implied warranties", r"this software is provided by the (?:copyright holders and contributors|authors?|regents(?: and contributors)?) \"?as is\"? and any express or implied warranties"),
    ("apache-2.0", "unless required", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e is distributed on an \"?as is\"? basis"),
    ("apache-2.0", "contributor license", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "patent", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable .{0,60}?patent licen[sc]e"),
    ("apache-1.1", "apache software", r"this product includes software developed by the apache software foundation"),
    ("gpl-3.0-only", "version 3", r"under the terms of (?:version 3 of the gnu general public licen[sc]e|the gnu general public licen[sc]e,? version 3)(?: only)?"),
    ("gpl-2.0-only", "version 2", r"under the terms of (?:version 2 of the gnu general public licen[sc]e|the gnu general public licen[sc]e,? version 2)(?: only)?"),
    ("gpl", "fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[sc]e"),
    ("lgpl", "fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl-3.0", "fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu affero general public licen[sc]e"),
    ("agpl-3.0", "through a computer network", r"offer all users interacting with it remotely through a computer network"),
    ("lgpl", "library is free software", r"this library is free software[:;,] you can redistribute it and/?(?:or)? modify"),
    ("lgpl-2.1-or-later", "version 2.1", r"either version 2\.1 of the licen[sc]e, or \(at your option\) any later version"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free, copyleft licen[sc]e"),
    ("gpl-exception", "as a special exception", r"as a special exception, (?:the copyright holders|you may|if you link|the author)"),
    ("gpl-2.0-with-classpath-exception", "classpath exception", r"gnu general public licen[sc]e .{0,60}?classpath exception"),
    ("gcc-exception-3.1", "gcc runtime library", r"gcc runtime library exception"),
    ("fdl-1.3", "documentation", r"permission is granted to copy, distribute and/?(?:or)? modify this document under the terms of the gnu free documentation"),
    ("mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. 2\.0"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1\.[01]"),
    ("mpl-2.0", "covered software", r"covered software is provided under this licen[sc]e on an \"?as is\"? basis"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl-2.0", "eclipse.org", r"https?://(?:www\.)?eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("epl-1.0", "eclipse.org", r"https?://(?:www\.)?eclipse\.org/legal/epl-v10"),
    ("cddl-1.0", "cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl-1.0", "cddl", r"https?://(?:www\.)?(?:sun\.com|opensolaris\.org)/(?:cddl|os/licensing)"),
    ("eupl-1.2", "eupl", r"licen[sc]ed under the eupl(?:,? version 1\.[12])?"),
    ("artistic-1.0", "state the conditions", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "artistic", r"https?://(?:www\.)?perlfoundation\.org/artistic_license_2_0"),
    ("bsl-1.0", "boost.org", r"https?://(?:www\.)?boost\.org/license_1_0\.txt"),
    ("busl-1.1", "change date", r"change date: .{0,200}?change licen[sc]e"),
    ("sspl-1.0", "to third parties as a service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unlicense.org", r"https?://(?:www\.)?unlicense\.org"),
    ("wtfpl", "wtfpl", r"https?://(?:www\.|sam\.zoy\.org/)?wtfpl(?:\.net)?"),
    ("cc0-1.0", "waived all copyright", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc-by-nc-sa", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-sa/\d\.\d"),
    ("cc-by-nc-nd", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-nd/\d\.\d"),
    ("cc-by-nd", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/\d\.\d"),
    ("public-domain", "creativecommons.org", r"https?://creativecommons\.org/publicdomain/mark/1\.0"),
    ("odbl-1.0", "opendatacommons.org", r"https?://(?:www\.)?opendatacommons\.org/licenses/odbl"),
    ("ofl-1.1", "scripts.sil.org", r"https?://scripts\.sil\.org/ofl"),
    ("ofl-1.1", "reserved font", r"with reserved font names?"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("python-2.0", "psf is making", r"psf is making python available to licensee on an \"?as is\"? basis"),
    ("php-3.01", "php software", r"this product includes php software, freely available from"),
    ("postgresql", "without fee", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("hpnd", "software and its documentation", r"permission to use, copy, modify,? (?:and )?distribute,? (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("ncsa", "deal with the software", r"deal with the software without restriction"),
    ("w3c", "w3.org", r"https?://(?:www\.)?w3\.org/consortium/legal"),
    ("ms-pl", "patent claim", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("upl-1.0", "lrgrwrks", r"any piece of software and/?(?:or)? hardware listed in the lrgrwrks\.txt"),
    ("vim", "copies of vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("json", "not evil", r"the software shall be used for good, not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("curl", "without fee", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted .{0,60}?copyright holder"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("proprietary", "written ", r"(?:no part of this|may not be) .{0,80}?(?:reproduced|copied|distributed) .{0,80}?without (?:the )?(?:express |prior )*written (?:permission|consent)"),
    ("proprietary", "contains ", r"contains (?:confidential|proprietary) (?:information|trade secrets)"),
    ("proprietary", "reverse engineer", r"(?:may|shall) not (?:copy, |modify, |decompile, |disassemble, |or )*reverse engineer"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of (?:this|any) .{0,60}?is (?:strictly )?prohibited"),
    ("all-rights-reserved", "rechte vorbehalten", r"alle rechte vorbehalten"),
    ("all-rights-reserved", "tous droits", r"tous droits r[eé]serv[eé]s"),
    ("all-rights-reserved", "todos los derechos", r"todos los derechos reservados"),
    ("non-commercial", "use only", r"for (?:non-?commercial|personal|academic|research) use only"),
    ("no-redistribution", "redistribution ", r"redistribution (?:is|of this .{0,40}? is) (?:not permitted|prohibited)"),
)


def build_rules() -> list[tuple[int, str, str, re.Pattern]]:
    """The ordered rules: passages first, then for each name its tag, grant, reference and bare
    forms (priority 2, 3, 4, 5; 1 is strongest)."""
    forms = (
        (2, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*{tag}" + _EDGE_R),
        (3, None, r"(?<!not )(?<!never )(?<!n't )(?:licensed|released|distributed|available|made available) under (?:the )?(?:terms of )?(?:the )?{name}"),
        (4, None, r"(?<!not )(?<!never )(?<!n't )(?:see|refer to|subject to|governed by|terms of|(?<!licensed )(?<!released )(?<!distributed )(?<!available )under) (?:the )?(?:terms of )?(?:the )?{name}"),
        (5, None, _EDGE_L + r"{name}" + _EDGE_R),
    )
    rules = [(1, label, keyword, re.compile(rx, re.S)) for label, keyword, rx in PASSAGES]
    for priority, keyword, form in forms:
        for label, own, rx in NAMES:
            body = form.replace("{tag}", re.escape(label) + r"(?:-only|-or-later)?").replace("{name}", rx.replace(" ", r"\s+"))
            rules.append((priority, label, keyword or own, re.compile(body)))
    return rules


#: White space other than a single blank, with the comment prefixes of the lines that it opens.
RUN = re.compile(r"[^\S\n]*\n\s*(?:(?:#+|//+|\*+(?!/)|;+|--+|%+|>+|!+|(?:dnl|rem)\b)\s*)*|[^\S\n]{2,}|[^\S\n ]")


def unwrapped(text: str) -> tuple[str, list[int], list[int]]:
    """The text with each run as one blank; where its pieces start, there and in the text."""
    parts, at, places, there = [], 0, [0], [0]
    size = 0
    for m in RUN.finditer(text):
        parts += [text[at : m.start()], " "]
        size += m.start() - at + 1
        at = m.end()
        places.append(size)
        there.append(at)
    return "".join([*parts, text[at:]]) if parts else text, places, there


class Cover:
    """Largest end of the intervals added that start at a place or before it, in log n: a Fenwick
    tree of maxima over the starts that will be asked for."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.ends = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def end(self, start: int) -> int:
        i, out = bisect_right(self.starts, start), -1
        while i:
            out = max(out, self.ends[i])
            i -= i & -i
        return out


class Scanner:
    """detect() gives kept detections (start, end, label, priority) of a lower-cased text. Rules read
    the text unwrapped; spans are those of the text itself."""

    def __init__(self, rules=None):
        import ahocorasick

        self.rules = build_rules() if rules is None else rules
        self.gate = ahocorasick.Automaton()
        # every match holds "licen" or the keyword of a rule that can do without
        loose = {k for _, k, rx in (*NAMES, *PASSAGES) if rx.endswith("licen[sc]e)?") or "licen[sc]e" not in rx} if rules is None else {r[2] for r in self.rules}
        for stem in sorted(loose | {"licen"}):
            self.gate.add_word(stem, stem)
        self.gate.make_automaton()
        self.words = ahocorasick.Automaton()
        for k, rule in enumerate(self.rules):
            self.words.add_word(rule[2], (*self.words.get(rule[2], ()), k))
        self.words.make_automaton()

    def detect(self, text: str) -> list[tuple[int, int, str, int]]:
        text, places, there = unwrapped(text)
        if next(self.gate.iter(text), None) is None:
            return []
        active = sorted({k for _, ks in self.words.iter(text) for k in ks})
        found = [(self.rules[k][0], m.start(), -m.end(), k) for k in active for m in self.rules[k][3].finditer(text)]
        kept, cover = [], Cover([f[1] for f in found])
        for priority, start, end, k in sorted(found):
            if cover.end(start) < -end:
                cover.add(start, -end)
                kept.append((start, -end, self.rules[k][1], priority))
        back = lambda at: there[k := bisect_right(places, at) - 1] + at - places[k]
        return sorted((back(s), back(e - 1) + 1, label, priority) for s, e, label, priority in kept)


_PHRASES = [(re.compile(_EDGE_L + SEP.join(map(re.escape, phrase.split())) + _EDGE_R), phrase.split()[-1], label) for phrase, label in BASE]
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Confidence by priority.
CONFIDENCE = {1: 0.99, 2: 0.98, 3: 0.95, 4: 0.85, 5: 0.7}


def scan_text(scanner: Scanner, text: str | None) -> dict:
    text = (text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower()
    n_words, starts, base = sum(1 for _ in WORD.finditer(text)), [], set()
    for rx, rare, label in _PHRASES:
        if rare in text:
            for m in rx.finditer(text):
                starts.append(m.start())
                base.add(label)
    places = sorted(starts)
    first = sum(1 for _ in WORD.finditer(text, 0, places[0])) if places else None
    last = sum(1 for _ in WORD.finditer(text, 0, places[-1])) if places else None
    kept = scanner.detect(text)
    miss = 1.0
    for *_, priority in kept:
        miss *= 1 - CONFIDENCE[priority]
    if places:
        miss *= 0.4
    return {
        "n_words": n_words, "n_base": len(places), "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {k[2] for k in kept})),
        "score": 1 - miss, "detections": [(s, e, label, p) for s, e, label, p in kept],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int>>"


def license_scan(docs: DataFrame, rules=None) -> DataFrame:
    """Scan whole texts; rules default to build_rules(). Detections carry code-point spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            out = pd.DataFrame([scan_text(scanner, t) for t in batch["text"]], columns=columns)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    return common.beside(docs, ["doc_id"], ["text"], run, SCHEMA)


def op1_license(spark, sf_dir) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents")).drop("detections")
