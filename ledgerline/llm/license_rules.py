"""Signature rules of license notices, in order.

A line is: label | weight | keyword | pattern.  Patterns are of words in lower
case with one space between them, and hold at whole words; a rule is tried only
on texts that hold its keyword.  `{v} ` may be "version", "v" or nothing, `{n}` is a form
of "licensed under the terms of".  A section's number is its rules' priority.
Weight: how sure a hit alone makes it that the text carries a license notice.
"""

from __future__ import annotations

#: Phrases whose places are all told, whatever else is found there.
BASE = """
cc-by | 0.6 | cc by | cc by
gpl | 0.7 | general public license | general public license
reserved | 0.5 | all rights reserved | all rights reserved
"""

RULES = """
[90] whole notices
mit | 0.99 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
x11 | 0.97 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
mit-0 | 0.95 | mit no attribution | mit no attribution(?: licen[sc]e)?
isc | 0.98 | permission to use copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?: provided that)?
0bsd | 0.98 | zero clause bsd | (?:bsd )?zero clause bsd(?: licen[sc]e)?
bsd | 0.97 | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-3-clause | 0.97 | endorse or promote products | neither the name of (?:[^ ]+ ){1,12}?may be used to endorse or promote products derived from this software
bsd-4-clause | 0.97 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 0.9 | freebsd project | the views and conclusions contained in the software and documentation are those of the authors (?:[^ ]+ ){0,24}?freebsd project
warranty-disclaimer | 0.8 | as is without warranty | (?:the software|this software|software) is provided as is without warranty of any kind(?: express or implied)?
warranty-disclaimer | 0.8 | merchantability | (?:implied )?warrant(?:y|ies) of merchantability(?: and| or)? (?:and )?fitness for a particular purpose
liability-disclaimer | 0.8 | be liable for any | in no event shall (?:[^ ]+ ){1,12}?be liable for any (?:claim|direct|damages)
apache-2.0 | 0.99 | apache license | licensed under the apache license{v} 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 0.97 | licenses license 2 0 | www apache org licenses license 2 0(?: txt| html)?
apache-1.1 | 0.95 | apache software foundation | this product includes software developed by the apache software foundation
gpl-or-later | 0.98 | general public license | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version [123](?: 0)? of the license or at your option any later version
lgpl-or-later | 0.98 | lesser general public license | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version [23](?: [01])? of the license or at your option any later version
agpl-or-later | 0.98 | affero general public license | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-notice | 0.9 | received a copy of the gnu | you should have received a copy of the gnu(?: lesser| library| affero)? general public license along with this (?:program|library)
mpl-2.0 | 0.98 | mozilla public license | this source code form is subject to the terms of the mozilla public license{v} 2 0
mpl-1.1 | 0.97 | mozilla public license | the contents of this file are subject to the mozilla public license{v} 1 1
mpl-2.0 | 0.95 | mozilla org mpl | mozilla org mpl 2 0
epl-2.0 | 0.97 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license(?:{v} 2 0)
epl-1.0 | 0.97 | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license{v} 1 0
cddl | 0.97 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
zlib | 0.97 | origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost-1.0 | 0.97 | boost software license | distributed under the boost software license{v} 1 0
boost-1.0 | 0.95 | license 1 0 txt | boost org license 1 0 txt
unlicense | 0.98 | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | 0.98 | what the fuck you want to | do what the fuck you want to public license
artistic-2.0 | 0.95 | artistic license | (?:terms of )?the artistic license 2 0
openssl | 0.95 | openssl project | this product includes software developed by the openssl project
php-3.01 | 0.95 | php license | this source file is subject to version 3 0?1 of the php license
python-2.0 | 0.93 | python software foundation license | python software foundation license(?: version 2)?
ofl-1.1 | 0.97 | sil open font license | this font software is licensed under the sil open font license{v} 1 1
cc0-1.0 | 0.97 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights
gfdl | 0.96 | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 0.85 | no invariant sections | with no invariant sections no front cover texts and no back cover texts
odbl-1.0 | 0.96 | open database license | made available under the open database license
curl | 0.93 | advertising or otherwise to promote | the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
hpnd | 0.9 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted
verbatim | 0.8 | verbatim copies | everyone is permitted to copy and distribute verbatim copies of this (?:license|licence) document

[80] names with a version
spdx | 0.95 | spdx license identifier | spdx license identifier(?: [^ ]+){1,3}
apache-2.0 | 0.95 | apache | {n}(?:the )?apache licen[sc]e{v} 2(?: 0)?
apache-2.0 | 0.9 | apache | apache(?: software)? licen[sc]e{v} 2(?: 0)?
apache-2.0 | 0.9 | apache 2 | apache 2(?: 0)?(?: licen[sc]ed?)?
apache-2.0 | 0.9 | apache2 | apache2(?: 0)?
apache-1.0 | 0.9 | apache | apache(?: software)? licen[sc]e{v} 1 0
apache-1.1 | 0.9 | apache | apache(?: software)? licen[sc]e{v} 1 1
gpl-1.0 | 0.95 | general public license | (?:gnu )?general public license{v} 1(?: 0)?
gpl-2.0 | 0.95 | general public license | (?:gnu )?general public license{v} 2(?: 0)?
gpl-3.0 | 0.95 | general public license | (?:gnu )?general public license{v} 3(?: 0)?
gpl-2.0-or-later | 0.96 | general public license | (?:gnu )?general public license{v} 2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-3.0-or-later | 0.96 | general public license | (?:gnu )?general public license{v} 3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
gpl-1.0 | 0.9 | gpl | gpl(?: v1| 1 0|v1)(?: 0)?
gpl-2.0 | 0.9 | gpl | (?:gnu )?gpl(?: v2| 2 0|v2| version 2)(?: 0)?
gpl-3.0 | 0.9 | gpl | (?:gnu )?gpl(?: v3| 3 0|v3| version 3)(?: 0)?
gpl-2.0-or-later | 0.92 | gpl | (?:gnu )?gpl(?: v2| 2|v2)(?: 0)?(?: or later| or any later version)
gpl-3.0-or-later | 0.92 | gpl | (?:gnu )?gpl(?: v3| 3|v3)(?: 0)?(?: or later| or any later version)
gpl-2.0 | 0.9 | gnu org licenses | gnu org licenses(?: old licenses)? gpl 2 0
gpl-3.0 | 0.9 | gnu org licenses | gnu org licenses gpl 3 0
lgpl-2.0 | 0.95 | general public license | (?:gnu )?library general public license{v} 2(?: 0)?
lgpl-2.1 | 0.95 | general public license | (?:gnu )?lesser general public license{v} 2 1
lgpl-3.0 | 0.95 | general public license | (?:gnu )?lesser general public license{v} 3(?: 0)?
lgpl-2.1 | 0.92 | lgpl | (?:gnu )?lgpl(?: v2 1| 2 1|v2 1| version 2 1)
lgpl-3.0 | 0.92 | lgpl | (?:gnu )?lgpl(?: v3| 3 0|v3| version 3)(?: 0)?
agpl-3.0 | 0.95 | affero general public license | (?:gnu )?affero general public license{v} 3(?: 0)?
agpl-1.0 | 0.93 | affero general public license | affero general public license{v} 1(?: 0)?
agpl-3.0 | 0.92 | agpl | (?:gnu )?agpl(?: v3| 3 0|v3| version 3)(?: 0)?
mpl-1.0 | 0.93 | mozilla public license | mozilla public license{v} 1 0
mpl-1.1 | 0.93 | mozilla public license | mozilla public license{v} 1 1
mpl-2.0 | 0.95 | mozilla public license | mozilla public license{v} 2(?: 0)?
mpl-1.1 | 0.85 | mpl | mpl(?: v1 1| 1 1|v1 1)
mpl-2.0 | 0.88 | mpl | mpl(?: v2| 2|v2)(?: 0)?
epl-1.0 | 0.93 | eclipse public license | eclipse public license{v} 1(?: 0)?
epl-2.0 | 0.93 | eclipse public license | eclipse public license{v} 2(?: 0)?
epl-1.0 | 0.8 | epl | epl(?: v1| 1|v1) 0
epl-2.0 | 0.85 | epl | epl(?: v2| 2|v2) 0
eupl-1.1 | 0.93 | eupl | eupl{v} 1 1
eupl-1.2 | 0.93 | eupl | eupl{v} 1 2
eupl-1.2 | 0.93 | european union public licen | european union public licen[sc]e(?:{v} 1 2)?
cddl-1.0 | 0.93 | cddl | cddl{v} 1 0
cddl-1.1 | 0.93 | cddl | cddl{v} 1 1
cpl-1.0 | 0.9 | common public license | common public license{v} 1 0
ipl-1.0 | 0.9 | ibm public license | ibm public license(?:{v} 1 0)?
osl-3.0 | 0.9 | open software license | open software license{v} 3 0
osl-2.1 | 0.9 | open software license | open software license{v} 2 1
afl-3.0 | 0.9 | academic free license | academic free license{v} 3 0
afl-2.1 | 0.9 | academic free license | academic free license{v} 2 1
boost-1.0 | 0.9 | boost software license | boost software license(?:{v} 1 0)?
boost-1.0 | 0.85 | bsl 1 0 | bsl 1 0
busl-1.1 | 0.92 | business source license | business source license(?:{v} 1 1)?
sspl-1.0 | 0.93 | server side public license | server side public license(?:{v} 1)?
elastic-2.0 | 0.93 | elastic license | elastic license{v} 2 0
ofl-1.1 | 0.92 | open font license | (?:sil )?open font license{v} 1 1
ofl-1.0 | 0.9 | open font license | (?:sil )?open font license{v} 1 0
gfdl-1.1 | 0.92 | free documentation license | (?:gnu )?free documentation license{v} 1 1
gfdl-1.2 | 0.92 | free documentation license | (?:gnu )?free documentation license{v} 1 2
gfdl-1.3 | 0.92 | free documentation license | (?:gnu )?free documentation license{v} 1 3
lppl-1.3c | 0.92 | latex project public license | latex project public license(?:{v} 1 3c?)?
qpl-1.0 | 0.9 | q public license | q public license(?:{v} 1 0)?
apsl-2.0 | 0.9 | apple public source license | apple public source license(?:{v} 2 0)?
ms-pl | 0.9 | microsoft public license | microsoft public license
ms-rl | 0.9 | microsoft reciprocal license | microsoft reciprocal license
npl-1.1 | 0.88 | netscape public license | netscape public license(?:{v} 1 [01])?
sissl | 0.88 | sun industry standards source license | sun industry standards source license
cecill-2.1 | 0.92 | cecill | (?:licence )?cecill(?: free software license agreement)?(?:{v} 2(?: [01])?)?
cecill-b | 0.92 | cecill b | (?:licence )?cecill b
cecill-c | 0.92 | cecill c | (?:licence )?cecill c
mulan-2.0 | 0.92 | mulan psl | mulan psl(?: v2| v1| 2 0)?
ncsa | 0.92 | ncsa open source license | (?:university of illinois )?ncsa open source license
postgresql | 0.9 | postgresql licen | postgresql licen[sc]e
ruby | 0.85 | ruby license | (?:the )?ruby license
unicode-dfs | 0.88 | unicode license agreement | unicode license agreement(?: data files and software)?
upl-1.0 | 0.9 | universal permissive license | universal permissive license(?:{v} 1 0)?
vim | 0.88 | vim licen | vim licen[sc]e
w3c | 0.9 | w3c software | w3c software(?: and document)?(?: notice and)? licen[sc]e
zpl-2.1 | 0.9 | zope public license | zope public license(?:{v} 2 [01])?
blueoak-1.0.0 | 0.9 | blue oak model license | blue oak model license(?: 1 0 0)?
bsd-2-clause | 0.93 | bsd 2 clause | bsd 2 clause(?: simplified)?(?: licen[sc]e)?
bsd-3-clause | 0.93 | bsd 3 clause | bsd 3 clause(?: new| revised)?(?: licen[sc]e)?
bsd-4-clause | 0.93 | bsd 4 clause | bsd 4 clause(?: original)?(?: licen[sc]e)?
bsd-2-clause | 0.92 | clause bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-3-clause | 0.92 | clause bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-4-clause | 0.92 | clause bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-2-clause | 0.9 | simplified bsd | simplified bsd(?: licen[sc]e)?
bsd-3-clause | 0.9 | bsd licen | (?:new|modified|revised) bsd licen[sc]e
cc0-1.0 | 0.93 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 0.9 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 0.88 | publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-1.0 | 0.93 | cc by | cc by{v} 1 0
cc-by-2.0 | 0.93 | cc by | cc by{v} 2 0
cc-by-2.5 | 0.93 | cc by | cc by{v} 2 5
cc-by-3.0 | 0.93 | cc by | cc by{v} 3 0
cc-by-4.0 | 0.95 | cc by | cc by{v} 4 0(?: international)?
cc-by-sa-1.0 | 0.93 | cc by sa | cc by sa{v} 1 0
cc-by-sa-2.0 | 0.93 | cc by sa | cc by sa{v} 2 0
cc-by-sa-2.5 | 0.93 | cc by sa | cc by sa{v} 2 5
cc-by-sa-3.0 | 0.95 | cc by sa | cc by sa{v} 3 0(?: unported)?
cc-by-sa-4.0 | 0.95 | cc by sa | cc by sa{v} 4 0(?: international)?
cc-by-nc-1.0 | 0.93 | cc by nc | cc by nc{v} 1 0
cc-by-nc-2.0 | 0.93 | cc by nc | cc by nc{v} 2 0
cc-by-nc-2.5 | 0.93 | cc by nc | cc by nc{v} 2 5
cc-by-nc-3.0 | 0.93 | cc by nc | cc by nc{v} 3 0(?: unported)?
cc-by-nc-4.0 | 0.95 | cc by nc | cc by nc{v} 4 0(?: international)?
cc-by-nd-2.0 | 0.93 | cc by nd | cc by nd{v} 2 0
cc-by-nd-2.5 | 0.93 | cc by nd | cc by nd{v} 2 5
cc-by-nd-3.0 | 0.93 | cc by nd | cc by nd{v} 3 0(?: unported)?
cc-by-nd-4.0 | 0.95 | cc by nd | cc by nd{v} 4 0(?: international)?
cc-by-nc-sa-2.0 | 0.93 | cc by nc sa | cc by nc sa{v} 2 0
cc-by-nc-sa-2.5 | 0.93 | cc by nc sa | cc by nc sa{v} 2 5
cc-by-nc-sa-3.0 | 0.93 | cc by nc sa | cc by nc sa{v} 3 0(?: unported)?
cc-by-nc-sa-4.0 | 0.95 | cc by nc sa | cc by nc sa{v} 4 0(?: international)?
cc-by-nc-nd-2.0 | 0.93 | cc by nc nd | cc by nc nd{v} 2 0
cc-by-nc-nd-2.5 | 0.93 | cc by nc nd | cc by nc nd{v} 2 5
cc-by-nc-nd-3.0 | 0.93 | cc by nc nd | cc by nc nd{v} 3 0(?: unported)?
cc-by-nc-nd-4.0 | 0.95 | cc by nc nd | cc by nc nd{v} 4 0(?: international)?
cc-by-4.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by 4 0
cc-by-3.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by 3 0
cc-by-sa-4.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | 0.93 | creativecommons org licenses by | creativecommons org licenses by nd 4 0
odc-by-1.0 | 0.92 | open data commons attribution | open data commons attribution licen[sc]e(?:{v} 1 0)?
pddl-1.0 | 0.92 | public domain dedication and licen | public domain dedication and licen[sc]e(?:{v} 1 0)?
cdla-permissive-2.0 | 0.92 | community data license agreement | community data license agreement permissive(?:{v} [12] 0)?
cdla-sharing-1.0 | 0.92 | community data license agreement | community data license agreement sharing(?:{v} 1 0)?
ogl-uk-3.0 | 0.9 | open government licen | open government licen[sc]e{v} 3 0
llama-community | 0.9 | community license agreement | llama [23](?: [0-9])? community license agreement
openrail | 0.9 | openrail | (?:creativeml )?(?:big ?science )?openrail(?: ?m)?

[60] names without a version
mit | 0.95 | mit licen | {n}(?:the )?mit licen[sc]e
mit | 0.9 | mit licen | (?:the )?mit licen[sc]ed?
mit | 0.85 | opensource org licenses mit | opensource org licenses mit
mit | 0.85 | expat licen | expat licen[sc]e
isc | 0.85 | isc licen | (?:the )?isc licen[sc]ed?
bsd | 0.85 | bsd | {n}(?:the |a )?bsd(?: style)? licen[sc]e
bsd | 0.8 | bsd | bsd(?: style)? licen[sc]ed?
apache | 0.85 | apache | {n}(?:the )?apache(?: software)? licen[sc]e
apache | 0.8 | apache | (?:the )?apache(?: software)? licen[sc]e
gpl-any | 0.85 | general public license | {n}(?:the )?(?:gnu )?general public license
lgpl-any | 0.85 | general public license | (?:gnu )?(?:lesser|library) general public license
agpl-any | 0.85 | affero general public license | (?:gnu )?affero general public license
gpl-any | 0.75 | gpl | (?:gnu )?gpl(?:ed)?
lgpl-any | 0.8 | lgpl | (?:gnu )?lgpl
agpl-any | 0.8 | agpl | (?:gnu )?agpl
mpl-any | 0.85 | mozilla public license | mozilla public license
epl-any | 0.85 | eclipse public license | eclipse public license
cddl | 0.85 | common development and distribution license | common development and distribution license
zlib | 0.8 | zlib | zlib(?: libpng)? licen[sc]e
artistic | 0.8 | artistic licen | (?:the |perl )?artistic licen[sc]e
php | 0.8 | php licen | php licen[sc]e
psf | 0.8 | psf licen | psf licen[sc]e(?: agreement)?
beerware | 0.85 | beerware | (?:the )?beerware(?: licen[sc]e)?
beerware | 0.85 | beer ware | (?:the )?beer ware(?: licen[sc]e)?
wtfpl | 0.85 | wtfpl | wtfpl(?: v2| 2 0| version 2)?
unlicense | 0.85 | unlicense | (?:the )?unlicense
json | 0.85 | used for good not evil | the software shall be used for good not evil
ofl | 0.8 | open font licen | (?:sil )?open font licen[sc]e
gfdl | 0.85 | free documentation license | (?:gnu )?free documentation license
odbl | 0.8 | odbl | odbl(?: 1 0)?
ogl | 0.8 | open government licen | open government licen[sc]e
etalab | 0.85 | licence ouverte | licence ouverte(?: open licence)?(?: etalab)?(?: 2 0)?
dl-de | 0.85 | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)?(?:{v} 2 0)?
cc-by | 0.9 | creative commons attribution | creative commons attribution(?:{v} [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-sa | 0.9 | creative commons attribution | creative commons attribution share ?alike(?:{v} [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc | 0.9 | creative commons attribution | creative commons attribution non ?commercial(?:{v} [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nd | 0.9 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?:{v} [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-sa | 0.9 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?:{v} [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-nd | 0.9 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?:{v} [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-sa | 0.8 | cc by sa | cc by sa
cc-by-nc | 0.8 | cc by nc | cc by nc
cc-by-nd | 0.8 | cc by nd | cc by nd
cc-by-nc-sa | 0.8 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 0.8 | cc by nc nd | cc by nc nd

[40] notices of rights
copyright-notice | 0.7 | copyright | copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?(?: by)?(?: [^ ]+){0,3}
copyright-notice | 0.6 | © | © (?:19|20)[0-9]{2}(?: [^ ]+){0,3}
copyright-notice | 0.6 | all rights reserved | copyright(?: [^ ]+){0,8}? all rights reserved
reserved | 0.5 | rights reserved | (?:some|no) rights reserved
reserved-fr | 0.6 | tous droits | tous droits (?:de reproduction )?réservés
reserved-de | 0.6 | rechte vorbehalten | alle rechte vorbehalten
reserved-es | 0.6 | derechos reservados | (?:todos los )?derechos reservados
reserved-it | 0.6 | diritti riservati | tutti i diritti riservati
reserved-pt | 0.6 | direitos reservados | todos os direitos reservados
public-domain | 0.7 | public domain | (?:released |dedicated |placed )?(?:in|into|to) the public domain
public-domain | 0.6 | domaine public | (?:dans le )?domaine public
public-domain | 0.5 | gemeinfrei | gemeinfrei
proprietary | 0.75 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 0.75 | unauthorized copying | unauthorized copying(?: of this file)?(?: via any medium)?(?: is)? strictly prohibited
proprietary | 0.6 | trade secret | trade secrets? (?:of|and)(?: [^ ]+){0,3}
proprietary | 0.6 | not be reproduced | (?:may not|must not) be reproduced(?: [^ ]+){0,6}? without (?:the )?(?:prior )?(?:written )?permission
proprietary | 0.6 | may not be redistributed | may not be redistributed
proprietary | 0.6 | end user license agreement | end user license agreement
non-commercial | 0.7 | non commercial | (?:for )?non commercial (?:use|purposes)(?: only)?
non-commercial | 0.7 | noncommercial | (?:for )?noncommercial (?:use|purposes)(?: only)?
research-only | 0.7 | research purposes only | (?:for )?(?:academic |scientific )?research purposes only
personal-use | 0.6 | personal use only | (?:for )?(?:your )?personal use only

[20] mentions
license-mention | 0.5 | licen | {n}(?:the |a |an )?[^ ]+(?: [^ ]+){0,3}? licen[sc]e
license-mention | 0.5 | licen | (?:see|read) (?:the )?(?:file )?licen[sc]e(?: txt| md| file)?(?: for (?:details|more information|terms))?
license-mention | 0.4 | license agreement | (?:software )?license agreement
license-mention | 0.4 | dual licen | dual licen[sc]ed?
license-mention | 0.4 | permissive | permissively? licen[sc]ed?
license-mention | 0.4 | copyleft | (?:strong |weak )?copyleft
license-mention | 0.4 | open source licen | (?:osi approved )?open source licen[sc]e
license-mention | 0.4 | free software licen | free software licen[sc]e
license-mention | 0.4 | lizenz | (?:lizenziert unter|unter der lizenz|lizenz)(?: [^ ]+){1,3}
license-mention | 0.4 | licence | sous (?:la )?licence(?: [^ ]+){1,3}
license-mention | 0.4 | licencia | bajo (?:la )?licencia(?: [^ ]+){1,3}
"""

SHORT = {"{v} ": "(?: version | v | v| )", "{n}": "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of )?"}
