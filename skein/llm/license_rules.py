"""License scans by ordered signature rules.

A text is reduced to its words, joined by single spaces. Hundreds of hand-written regular expressions over words report intervals of words: license texts and notices,
addresses, declared identifiers, grants, references and bare names. A keyword prefilter stands before them: a text without any of GATE, which every match holds, is
not looked at, and of the others a rule runs only where one of its own keywords occurs. Rules have a priority, 1 the strongest; a detection contained in another of the same
or a stronger priority is suppressed, and of equal intervals the stronger, then earlier rule stays. Base phrases are always kept. Only built-in functions
run on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import let, lower_ascii, texts
from skein.llm.matches import pieces, placed, spaces

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Strings of which every match of every rule holds one.
GATE = (
    "licen", "gpl", "gnu ", "bsd", "apache", "mozilla", " mpl", "cddl", "eupl", "cc0", "cc by", "creative commons", "creativecommons", "spdx", "wtfpl", "openrail", "odbl", "odc by",
    "cdla", "public domain", "publicdomain", "rights reserved", "proprietary", "copyright", "permission", "redistribution", "free software", "warrant", "unencumbered", "misrepresented",
    "released under", "distributed under", "available under", "published under", "provided under", "buy me a beer", "advertising materials", "eclipse org", "mit x11", "expat x11", "x consortium", "good not evil", "unauthorized copying", "endorse or promote",
)

#: Hand-written signatures of license texts, notices and addresses, one a line: priority, label, keywords parted by |, pattern over words.
SIGNATURES = r"""
2; mit; obtaining a copy; permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work|program|library)
2; mit; without restriction; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
2; mit; permission notice; the above copyright notice and this permission notice shall be included in all copies(?: or substantial portions of the software)?
3; mit; without warranty; the software is provided as is without warranty of any kind express or implied
3; mit; copyright holders; in no event shall the authors or copyright holders be liable for any claim damages or other liability
2; mit-0; hereby granted; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction(?: [^ ]+){15,40} permit persons to whom the software is furnished to do so the software is provided as is
2; isc; with or without fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3; isc; disclaims all warranties; the software is provided as is and the author disclaims all warranties with regard to this software
2; 0bsd; with or without fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
2; bsd; source and binary forms; redistribution and use in source and binary forms with or without modification are permitted
3; bsd; must retain; redistributions? of source code must retain the above copyright notice
3; bsd; must reproduce; redistributions? in binary form must reproduce the above copyright notice
2; bsd-3-clause; endorse or promote; neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|his|their|other) contributors may be used to endorse or promote products
2; bsd-3-clause; endorse or promote; the names? of (?:[^ ]+ ){1,12}may not be used to endorse or promote products derived from this software without
2; bsd-4-clause; advertising materials; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
3; bsd; contributors; this software is provided by the copyright holders and contributors as is and any express or implied warranties
2; bsd-2-clause; freebsd; views and conclusions contained in the software and documentation are those of the authors(?: [^ ]+){1,20} freebsd project
2; bsd-patent; patent; bsd (?:2 clause )?plus patent license
2; bsd-3-clause-clear; no express or implied; no express or implied licenses to any party s patent rights are granted by this license
2; apache-2.0; apache; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
2; apache-2.0; apache; (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
2; apache-1.1; apache; (?:https? )?(?:www )?apache org licenses license 1 1(?: txt| html)?
3; apache-2.0; as is basis; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2; apache-2.0; january 2004; apache license version 2 0 january 2004
2; apache-2.0; each contributor; subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)
2; apache-2.0; attribution notices; you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices
2; apache-1.1; apache software foundation; this product includes software developed by the apache software foundation
2; apache-2.0; software foundation; licensed to the apache software foundation asf under one or more contributor license agreements
2; gpl-3.0; version 3; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
2; gpl-2.0; version 2; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?(?: or at your option any later version)?
2; gpl-1.0; version 1; free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 1(?: or at your option any later version)?
2; gpl; free software; free software you can redistribute it and or modify it under the terms of the gnu general public license
2; lgpl-2.1; version 2 1; free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?(?: or at your option any later version)?
2; lgpl-3.0; version 3; free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
2; lgpl-2.0; version 2; free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2(?: of the license)?(?: or at your option any later version)?
2; lgpl; free software; free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
2; agpl-3.0; version 3; free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
3; gpl; should have received; you should have received a copy of the gnu general public license along with (?:this|the) (?:program|software|library|file|package)
3; lgpl; should have received; you should have received a copy of the gnu (?:lesser|library) general public license along with (?:this|the) (?:program|software|library|file|package)
3; agpl; should have received; you should have received a copy of the gnu affero general public license along with (?:this|the) (?:program|software|library|file|package)
3; gpl; in the hope; is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
3; lgpl; in the hope; is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license
3; agpl; in the hope; is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
2; gpl-1.0; february 1989; gnu general public license version 1 february 1989
2; gpl-2.0; june 1991; gnu general public license version 2 june 1991
2; gpl-3.0; june 2007; gnu general public license version 3 29 june 2007
2; lgpl-2.0; june 1991; gnu library general public license version 2 june 1991
2; lgpl-2.1; february 1999; gnu lesser general public license version 2 1 february 1999
2; lgpl-3.0; june 2007; gnu lesser general public license version 3 29 june 2007
2; agpl-3.0; november 2007; gnu affero general public license version 3 19 november 2007
2; agpl-1.0; march 2002; affero general public license version 1 march 2002
2; gpl-2.0; take away your freedom; the licenses for most software are designed to take away your freedom to share and change it
2; gpl-3.0; copyleft; the gnu general public license is a free copyleft license for software and other kinds of works
2; agpl-3.0; network server; the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
2; lgpl-2.1; lesser; this license the lesser general public license applies to some specially designated software packages
2; lgpl-3.0; incorporates the terms; this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
2; gpl-classpath; classpath; gnu general public license(?: version 2)?(?: gplv?2?)? with (?:the )?classpath exception
2; gpl-linking; special exception; as a special exception the copyright holders of this library give you permission to link this library with independent modules
2; gpl-3.0; gnu org; (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
2; gpl-2.0; gnu org; (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
2; lgpl-3.0; gnu org; (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
2; lgpl-2.1; gnu org; (?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?
2; agpl-3.0; gnu org; (?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
3; gpl; gnu org; (?:https? )?(?:www )?gnu org (?:copyleft|licenses) gpl(?: html| txt)?
3; lgpl; gnu org; (?:https? )?(?:www )?gnu org (?:copyleft|licenses) (?:lgpl|lesser)(?: html| txt)?
3; gfdl; gnu org; (?:https? )?(?:www )?gnu org (?:copyleft|licenses) fdl(?: 1 [123])?(?: html| txt)?
2; gfdl; documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2; mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
2; mpl-2.0; mpl; if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0
2; mpl-2.0; incompatible with secondary; this source code form is incompatible with secondary licenses as defined by the mozilla public license
2; mpl-1.1; mozilla; the contents of this file are subject to the mozilla public license version 1 1
2; mpl-1.0; contents of this file; the contents of this file are subject to the (?:mozilla|netscape) public license version 1 0(?: the license)
2; mpl-2.0; mozilla org; (?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0
3; mpl; mozilla org; (?:https? )?(?:www )?mozilla org mpl
2; epl-1.0; eclipse; are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
2; epl-2.0; eclipse; are made available under the terms of the eclipse public license v(?:ersion)? ?2 0
2; epl-1.0; eclipse org; (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
2; epl-2.0; eclipse org; (?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
2; cpl-1.0; common public; are made available under the terms of the common public license v(?:ersion)? ?1 0
2; cddl-1.0; common development; the contents of this file are subject to the terms of the common development and distribution license
2; cddl-1.1; common development; common development and distribution license(?: cddl)? (?:version |v)?1 1
2; bsl-1.0; person or organization; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
2; bsl-1.0; boost org; (?:https? )?(?:www )?boost org license 1 0(?: txt)?
2; bsl-1.0; boost; distributed under the boost software license version 1 0
2; zlib; arising from the use; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
2; zlib; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
3; zlib; plainly marked; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
2; libpng; libpng; this code is released under the libpng license
2; unlicense; unencumbered; this is free and unencumbered software released into the public domain
2; unlicense; unlicense org; (?:https? )?(?:www )?unlicense org
2; wtfpl; what the fuck; do what the fuck you want to public license
2; wtfpl; wtfpl; (?:https? )?(?:www )?wtfpl net
2; cc0-1.0; associated a work; the person who associated a work with this deed has dedicated the work to the public domain
2; cc0-1.0; waived all; has waived all copyright and related or neighboring rights to
2; cc0-1.0; zero; (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
3; public-domain; mark; (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
2; cc-by-nc-nd; creativecommons; (?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05](?: [a-z]{2})?
2; cc-by-nc-sa; creativecommons; (?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05](?: [a-z]{2})?
2; cc-by-nc; creativecommons; (?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05](?: [a-z]{2})?
2; cc-by-nd; creativecommons; (?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05](?: [a-z]{2})?
2; cc-by-sa; creativecommons; (?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05](?: [a-z]{2})?
2; cc-by; creativecommons; (?:https? )?(?:www )?creativecommons org licenses by [1-4] [05](?: [a-z]{2})?
2; cc-by-nc-nd; deriv; creative commons attribution non ?commercial no ?deriv(?:atives?|ativeworks?|s)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license| licence)
2; cc-by-nc-sa; alike; creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license| licence)
2; cc-by-nc; commercial; creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license| licence)
2; cc-by-nd; deriv; creative commons attribution no ?derivatives(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license| licence)
2; cc-by-sa; alike; creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license| licence)
2; cc-by; attribution; creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license| licence)
3; cc-by-sa; text is available; text is available under the creative commons attribution share ?alike licen[cs]e
2; artistic-1.0; copied; the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains
2; artistic-2.0; free software package; this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
3; artistic; perl; you can redistribute it and or modify it under the same terms as perl itself(?: [^ ]+){0,8} license
2; ofl-1.1; font software; this font software is licensed under the sil open font license(?: version 1 1)?
2; ofl-1.1; scripts sil org; (?:https? )?scripts sil org ofl(?: [^ ]+){0,3} license
2; psf-2.0; psf; psf hereby grants licensee a nonexclusive royalty free world ?wide license
2; psf-2.0; psf; psf is making python available to licensee on an as is basis
2; php-3.01; php; this source file is subject to version 3 01? of the php license
2; php-3.01; php; this product includes php software freely available from(?: [^ ]+){1,6} license
2; postgresql; written agreement; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
2; hpnd; hereby granted without fee; permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
2; hpnd; hereby granted; permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
2; x11; x consortium; except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written (?:authorization|permission)
2; ncsa; with the software; developed by (?:[^ ]+ ){1,20}permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
2; openssl; openssl; this product includes (?:cryptographic )?software developed by the openssl project(?: [^ ]+){1,20} license
2; ssleay; cryptographic software; this product includes cryptographic software written by eric young(?: [^ ]+){1,20} (?:license|copyright)
2; ruby; verbatim copies; you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices
2; vim; unmodified copies of vim; there are no restrictions on distributing unmodified copies of vim except that they must include this license text
2; beerware; buy me a beer; if we meet some day and you think this stuff is worth it you can buy me a beer
2; json; good not evil; the software shall be used for good not evil
2; ms-pl; accompanying software; this license governs use of the accompanying software if you use the software you accept this license
2; sspl-1.0; october 16 2018; server side public license version 1 october 16 2018
2; sspl-1.0; mongodb; (?:https? )?(?:www )?mongodb com licensing server side public license
2; elastic-2.0; hosted or managed; you may not provide the software to third parties as a hosted or managed service(?: [^ ]+){1,40} license
2; elastic-2.0; elastic co; (?:https? )?(?:www )?elastic co licensing elastic license
2; busl-1.1; change date; business source license 1 1(?: [^ ]+){0,60} change date
2; busl-1.1; mariadb; (?:https? )?(?:www )?mariadb com bsl11(?: [^ ]+){0,6} license
2; commons-clause; commons clause; commons clause license condition
2; commons-clause; right to sell; the grant of rights under the license will not include and the license does not grant to you the right to sell the software
2; polyform-noncommercial; polyform; polyform noncommercial license(?: 1 0 0)?
2; polyform-small-business; polyform; polyform small business license(?: 1 0 0)?
2; polyform-shield; polyform; polyform shield license(?: 1 0 0)?
2; llama-2; llama; llama 2 community license(?: agreement)?
2; llama-3; llama; (?:meta )?llama 3(?: [1-9])? community license(?: agreement)?
2; openrail; use based restrictions; use based restrictions(?: [^ ]+){1,30} license
2; openrail; responsible ai; responsible ai licen[cs]e
2; odbl-1.0; open database license; open database license(?: odbl)?(?: (?:version |v)?1 0)?
2; odbl-1.0; opendatacommons; (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?
2; odc-by-1.0; opendatacommons; (?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?
2; pddl-1.0; opendatacommons; (?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?
2; ogl-3.0; open government; contains public sector information licensed under the open government licence(?: v(?:ersion)? ?3 0)?
2; ogl; open government; open government licen[cs]e(?: v(?:ersion)? ?[123] 0)?
2; cdla-permissive; community data; community data license agreement permissive(?: version)?(?: [12] 0)?
2; cdla-sharing; community data; community data license agreement sharing(?: version)?(?: 1 0)?
2; eupl-1.2; eupl; licensed under the eupl(?: version)? ?1 2(?: or later)?
2; eupl-1.1; eupl; licensed under the eupl(?: version)? ?1 1(?: or later)?
2; cecill-2.1; cecill; (?:governed by the )?cecill(?: free software)? license(?: agreement)?(?: version)? ?2 1
2; cecill; cecill; (?:governed by the )?cecill(?: [abc])?(?: free software)? license
2; afl-3.0; academic free; academic free license(?: (?:version |v)?3 0)?
2; osl-3.0; open software license; open software license(?: (?:version |v)?3 0)?
2; ecl-2.0; educational community; educational community license(?: (?:version |v)?2 0)?
2; mulan-2.0; mulan; mulan (?:psl|permissive software license)(?: ?v(?:ersion)? ?2)?(?: license)
2; upl-1.0; universal permissive; universal permissive license(?: (?:version |v)?1 0)?
2; ipl-1.0; ibm public; ibm public license(?: (?:version |v)?1 0)?
2; apsl-2.0; apple public; apple public source license(?: (?:version |v)?2(?: 0)?)?
2; sleepycat; sleepycat; sleepycat (?:public )?license
2; tcl; tcl; (?:tcl tk|tcl) license
2; curl; curl; curl license
2; ijg; independent jpeg; this software is based in part on the work of the independent jpeg group(?: [^ ]+){0,20} (?:license|copyright)
2; free-type; freetype; freetype (?:project )?license
2; info-zip; info zip; info zip license
2; w3c; w3c; w3c software (?:notice and )?license
2; unicode; unicode; unicode (?:inc )?license agreement
2; icu; icu; icu license
2; opl-1.0; open publication; open publication license(?: (?:version |v)?1 0)?
2; proprietary; confidential; confidential and proprietary information of
2; proprietary; unauthorized copying; unauthorized copying of this file via any medium is strictly prohibited
2; proprietary; licensed not sold; (?:the|this) software is licensed not sold
2; proprietary; evaluation; evaluation license agreement
2; proprietary; end user; end user licen[cs]e agreement
3; reserved; reproduced; no part of this (?:publication|book|document|work|website) may be reproduced(?: [^ ]+){1,40} (?:permission|copyright)
3; reserved; prohibited; reproduction(?: [^ ]+){0,6} without (?:written |prior |express ){0,3}permission is prohibited
4; copyright; copyright; copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
2; mit; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? mit(?: license)?(?: php)?
2; bsd-3-clause; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? bsd 3 clause
2; bsd-2-clause; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? bsd 2 clause
3; bsd; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? bsd license(?: php)?
2; apache-2.0; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? apache 2 0
2; isc; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? isc
2; gpl-3.0; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? gpl 3 0
2; gpl-2.0; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? gpl 2 0
2; mpl-2.0; opensource org; (?:https? )?(?:www )?opensource org licen[cs]es? mpl 2 0
2; mit; choosealicense; (?:https? )?(?:www )?choosealicense com licenses mit
2; apache-2.0; choosealicense; (?:https? )?(?:www )?choosealicense com licenses apache 2 0
2; gpl-3.0; choosealicense; (?:https? )?(?:www )?choosealicense com licenses gpl 3 0
3; spdx; spdx org; (?:https? )?(?:www )?spdx org licenses
"""

#: (label, keywords parted by |, name as a pattern over words). One of the keywords stands in every match.
FAMILIES = (
    ("apache-2.0", "apache", r"apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?(?:license )?(?:version |v)?1 1"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit", "mit|expat", r"(?:mit|expat) (?:license|licence|x11)"),
    ("x11", "x11", r"x11 (?:license|licence)"),
    ("isc", "isc", r"isc (?:license|licence)"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|two clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd (?:style )?(?:license|licence)"),
    ("gpl-1.0", "gnu", r"gnu (?:general public license|gpl)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu (?:general public license|gpl)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu (?:general public license|gpl)(?: version| v)? ?3(?: 0)?"),
    ("gpl-2.0", "gpl|gpl2|gplv2|gplversion", r"gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl|gpl3|gplv3|gplversion", r"gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("gpl", "gnu", r"gnu (?:general public license|gpl)"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl|lgpl2|lgplv2|lgplversion", r"lgpl ?(?:version |v)?2 1"),
    ("lgpl-3.0", "lgpl|lgpl3|lgplv3|lgplversion", r"lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?"),
    ("agpl-3.0", "agpl|agpl3|agplv3|agplversion", r"agpl ?(?:version |v)?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?: (?:version |v)?1 [123])?"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v)?2(?: 0)?"),
    ("mpl-2.0", "mpl|mpl2|mplv2|mplversion", r"mpl ?(?:version |v)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v)?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v)?2 0"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl-1.0", "cddl", r"cddl(?: (?:version |v)?1 0)?"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cpl-1.0", "common", r"common public license(?: (?:version |v)?1 0)?"),
    ("eupl-1.1", "eupl|eupl1|euplv1|euplversion", r"eupl ?(?:version |v)?1 1"),
    ("eupl-1.2", "eupl|eupl1|euplv1|euplversion", r"eupl ?(?:version |v)?1 2"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic license (?:version |v)?2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic license (?:version |v)?1(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsl-1.0", "boost", r"boost software license(?: (?:version |v)?1 0)?"),
    ("busl-1.1", "business", r"business source license(?: (?:version |v)?1 1)?"),
    ("sspl-1.0", "server", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license(?: (?:version |v)?2(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("psf-2.0", "python", r"python software foundation license(?: (?:version |v)?2)?"),
    ("php-3.01", "php", r"php license(?: (?:version |v)?3 01)?"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? license"),
    ("openssl", "openssl", r"openssl license"),
    ("ruby", "ruby", r"ruby license"),
    ("vim", "vim", r"vim license"),
    ("ofl-1.1", "sil", r"sil open font license(?: (?:version |v)?1 1)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("odbl-1.0", "odbl", r"odbl(?: (?:version |v)?1 0)?"),
    ("odc-by-1.0", "odc", r"odc by(?: (?:version |v)?1 0)?"),
    ("cdla-permissive", "cdla", r"cdla permissive(?: 2 0| 1 0)?"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "nc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by [1-4] [05]"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "sharealike|share", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: [1-4] [05])?"),
    ("public-domain", "domain", r"(?:dedicated to|placed in|in) the public domain"),
    ("reserved", "reserved", r"(?:all|some) rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
)
#: Names that say a license only after a declaration or a grant (priorities 1 and 2), as FAMILIES. Of equal intervals those of FAMILIES stay.
BARE = (
    ("mit", "mit|expat", r"(?:mit|expat)"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("bsd", "bsd", r"bsd"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("apache", "apache", r"apache"),
    ("gpl-1.0", "gpl|gpl1|gplv1|gplversion", r"gpl ?(?:version |v)?1(?: 0)?"),
    ("gpl", "gpl", r"gpl"),
    ("lgpl", "lgpl", r"lgpl"),
    ("agpl", "agpl", r"agpl"),
    ("gfdl", "gfdl", r"gfdl(?: (?:version |v)?1 [123])?"),
    ("mpl-1.1", "mpl", r"mpl (?:version |v)?1 1"),
    ("mpl", "mpl", r"mpl"),
    ("epl-1.0", "epl", r"epl (?:version |v)?1 0"),
    ("epl-2.0", "epl", r"epl (?:version |v)?2 0"),
    ("epl", "epl", r"epl"),
    ("cpl-1.0", "cpl", r"cpl (?:version |v)?1 0"),
    ("eupl", "eupl", r"eupl"),
    ("artistic-2.0", "artistic", r"artistic (?:version |v)?2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic (?:version |v)?1(?: 0)?"),
    ("bsl-1.0", "bsl", r"bsl 1 0"),
    ("busl-1.1", "busl", r"busl 1 1"),
    ("sspl-1.0", "sspl", r"sspl(?: 1 0)?"),
    ("elastic-2.0", "elastic", r"elastic (?:version |v)?2(?: 0)?"),
    ("psf-2.0", "psf", r"psf 2 0"),
    ("php-3.01", "php", r"php (?:version |v)?3 01"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"ncsa"),
    ("openssl", "openssl", r"openssl"),
    ("ruby", "ruby", r"ruby"),
    ("vim", "vim", r"vim"),
    ("ofl-1.1", "ofl", r"ofl 1 1"),
    ("ms-pl", "ms", r"ms pl"),
    ("ms-rl", "ms", r"ms rl"),
)
#: (priority, keyword or empty for the family's own, pattern around a name). A declared identifier, then a grant, a reference, a bare name.
PHRASES = (
    (1, "spdx", r"spdx license identifier {name}(?: or later| only)?"),
    (2, "", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: license| licence)?(?: version [0-9]+(?: [0-9]+)?)?"),
    (3, "", r"(?:see|under|subject to|accept|governed by|conditions of|copy of) (?:the )?{name}(?: license| licence)?"),
    (4, "", r"{name}"),
)
CONFIDENCE = (1.0, 0.9, 0.8, 0.6)


def signatures() -> list[tuple[int, str, str, str]]:
    return [(int(p), label, keywords, rx) for p, label, keywords, rx in (line.split("; ", 3) for line in SIGNATURES.strip().splitlines())]


def rules() -> list[tuple[int, int, str, str, str]]:
    """(number, priority, label, keywords parted by |, pattern over words), in order."""
    every = list(signatures())
    for priority, keyword, around in PHRASES:
        for label, own, name in FAMILIES + (BARE if priority <= 2 else ()):
            every.append((priority, label, keyword or own, around.format(name=f"(?:{name})")))
    return [(n, p, label, keywords, f"(?<= ){rx}(?= )") for n, (p, label, keywords, rx) in enumerate(every)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for every row.

    detections are those that stay: (label, priority, start, stop) in words. A text without words, empty or null has no places, null
    first and last words and score 0. Rows with equal id and text get equal results; rows that share an id but not a text are told apart. An empty table gives an empty result.
    """
    docs = texts(docs, id_col, text_col)
    line = F.trim(F.regexp_replace(lower_ascii(F.col("text")), NO_WORD, " "))
    docs = docs.select("doc_id", line.alias("line")).select("doc_id", F.concat(F.lit(" "), "line", F.lit(" ")).alias("s"), F.when(F.col("line") == "", 0).otherwise(spaces(F.col("line")) + 1).cast("long").alias("n_words"))
    places = []
    for phrase, label in BASE:
        parts = F.split("s", f"(?<= ){phrase}(?= )", -1)
        n = F.size(parts) - 1
        first = spaces(F.get(parts, F.lit(0))) - 1
        last = F.col("n_words") - (spaces(F.element_at(parts, -1)) - 1) - (phrase.count(" ") + 1)
        got = F.when(F.contains("s", F.lit(f" {phrase} ")), F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label")))
        places.append(got)
    docs = docs.withColumn("base", F.array_compact(F.array(*places)))
    docs = docs.select(
        "doc_id", "s", "n_words", F.xxhash64("s").alias("of"),
        F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_base"),
        F.array_min(F.transform("base", lambda x: x.first)).alias("first_word"), F.array_max(F.transform("base", lambda x: x.last)).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda x: x.label))).alias("base_set"),
    )
    table = rules()
    literal = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.array(*map(F.lit, k.split("|"))).alias("any"), F.lit(rx).alias("rx")) for n, p, label, k, rx in table))
    # s is bound before any lambda: a column that a lambda names may be made anew for each element
    gated = docs.where(let(F.col("s"), lambda s: F.exists(F.array(*map(F.lit, GATE)), lambda k: F.contains(s, k)))).select("doc_id", "of", "s")
    told = lambda r: lambda m, i: F.struct(r.rule.alias("rule"), r.priority.alias("priority"), r.label.alias("label"), i.alias("ord"), m.gap.alias("gap"), m["size"].alias("size"))
    open_rules = lambda s: F.filter(literal, lambda r: F.exists(r["any"], lambda k: F.contains(s, k)))
    fired = let(F.col("s"), lambda s: F.flatten(F.transform(open_rules(s), lambda r: F.transform(pieces(s, r.rx, spaces), told(r)))))
    # a match of n words holds n - 1 spaces, and the one before the first word of the text starts at 1
    rows = placed(gated.select("doc_id", "of", F.inline(fired)), ["doc_id", "of", "rule"])
    order = Window.partitionBy("doc_id", "of").orderBy("start", F.desc("stop"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in range(1, 5):
        reach = F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(order)
        covered = covered | ((F.col("priority") == p) & F.coalesce(reach >= F.col("stop"), F.lit(False)))
    kept = rows.withColumn("covered", covered).where("NOT covered")
    kept = kept.groupBy("doc_id", "of").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - 1).alias("start"), F.col("stop").alias("stop"), "label", "priority"))).alias("detections"))
    kept = kept.withColumnRenamed("doc_id", "kept_id").withColumnRenamed("of", "kept_of")
    none = F.expr("CAST(array() AS array<struct<start:long,stop:long,label:string,priority:int>>)")
    out = docs.drop("s").join(kept.hint("merge"), F.expr("doc_id <=> kept_id AND of = kept_of"), "left").withColumn("detections", F.coalesce("detections", none))
    best = F.array_min(F.transform("detections", lambda d: d.priority))
    level = F.when(best == 1, CONFIDENCE[0]).when(best == 2, CONFIDENCE[1]).when(best == 3, CONFIDENCE[2]).when(best == 4, CONFIDENCE[3])
    score = F.coalesce(level, F.when(F.size("base_set") > 0, F.lit(0.5)), F.lit(0.0))
    every = F.array_sort(F.array_union("base_set", F.transform("detections", lambda d: d.label)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), "detections")
