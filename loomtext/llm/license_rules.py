"""The signature rules of the license scan: hand-written expressions by label, and identifier rules made from the labels.

An expression is matched against a text's words (lower case, digits kept, all else a blank) joined by single blanks, from
the start of a word to the end of one. It must begin with plain letters: the keyword that gates it. The digit before
it is its priority: 1 license text and declared identifiers, 2 names with a version and addresses, 3 names without one,
4 mere hints. The first four labels of BASE are fixed values.
"""

from __future__ import annotations

import re
from typing import NamedTuple

CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.3}

#: Phrases that always count, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SIGNATURES = r"""
mit
1 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 licensed under (?:the )?(?:terms of the )?mit(?: license)?
2 released under (?:the )?(?:terms of the )?mit(?: license)?
2 distributed under (?:the )?(?:terms of the )?mit(?: license)?
2 opensource org licen[sc]es mit(?: license(?: php)?)?
2 choosealicense com licenses mit
3 mit licensed
3 mit x11 license
3 mit style licen[sc]e
3 expat license
3 license mit
mit-0
1 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:\S+ ){0,60}?without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
2 mit no attribution
2 opensource org licenses mit 0
x11
1 except as contained in this notice the name of the x consortium shall not be used
3 x11 license
isc
1 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
2 opensource org licenses isc(?: license(?: txt)?)?
2 licensed under (?:the )?(?:terms of the )?isc
3 isc licen[sc]ed?
0bsd
2 zero clause bsd
2 bsd zero clause
2 free public license 1 0 0
2 opensource org licenses 0bsd
3 0bsd
bsd-2-clause
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
2 bsd 2 clause
2 two clause bsd
2 2 clause bsd
2 simplified bsd license
2 freebsd license
2 opensource org licenses bsd 2 clause
bsd-3-clause
1 neither the name of (?:\S+ ){1,16}?nor the names of its contributors may be used to endorse or promote products derived from this software
1 neither the names? of (?:\S+ ){1,16}?may be used to endorse or promote products derived from this software
2 bsd 3 clause
2 three clause bsd
2 3 clause bsd
2 new bsd license
2 modified bsd license
2 revised bsd license
2 opensource org licenses bsd 3 clause
bsd-4-clause
1 all advertising materials mentioning features or use of this software must display the following acknowledgement
2 bsd 4 clause
2 four clause bsd
2 original bsd license
bsd
1 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 bsd licen[sc]ed?
3 bsd style licen[sc]e
3 opensource org licenses bsd license(?: php)?
apache-2.0
1 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 apache license version 2 0 january 2004
1 grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
2 apache license (?:version |v )?2(?: 0)?
2 apache software license (?:version |v )?2(?: 0)?
2 apache 2(?: 0)? license
2 apache 2 0
2 apache org licenses license 2 0
2 opensource org licenses apache 2 0
2 asl 2 0
apache-1.1
1 this product includes software developed by the apache software foundation
2 apache software license version 1 1
2 apache license (?:version |v )?1 1
2 apache org licenses license 1 1
apache-1.0
2 apache license (?:version |v )?1 0
2 apache org licenses license 1 0
apache
3 licensed under (?:the )?apache
3 apache licensed
3 apache software license
gpl-1.0
2 gnu general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion )?1(?: 0)?
2 gpl v?1 0
gpl-2.0
1 gnu general public license version 2 june 1991
2 gnu general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion )?2(?: 0)?
2 gnu general public license v2
2 gnu gpl (?:version |v )?2(?: 0)?
2 gpl version 2
2 gpl v ?2(?: 0)?
2 gplv2
2 gpl 2 0
2 gnu org licenses (?:old licenses )?gpl 2 0
2 opensource org licenses gpl 2 0
gpl-2.0-or-later
1 either version 2 of the license or at your option any later version
2 gpl 2 0 or later
2 gpl version 2 or (?:\S+ ){0,3}?later
2 gplv2 or later
2 gnu general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or (?:\S+ ){0,4}?later(?: version)?
gpl-3.0
1 gnu general public license version 3 29 june 2007
1 the gnu general public license is a free copyleft license for software and other kinds of works
2 gnu general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion )?3(?: 0)?
2 gnu general public license v3
2 gnu gpl (?:version |v )?3(?: 0)?
2 gpl version 3
2 gpl v ?3(?: 0)?
2 gplv3
2 gpl 3 0
2 gnu org licenses gpl 3 0
2 opensource org licenses gpl 3 0
gpl-3.0-or-later
1 either version 3 of the license or at your option any later version
2 gpl 3 0 or later
2 gpl version 3 or (?:\S+ ){0,3}?later
2 gplv3 or later
2 gnu general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:\S+ ){0,4}?later(?: version)?
gpl
3 gnu gpl
3 gnu public license
3 general public license
3 licensed under (?:the )?(?:terms of the )?gpl
3 released under (?:the )?(?:terms of the )?gpl
3 gnu org licenses gpl
3 gpl licensed
3 license gpl
4 this program is free software you can redistribute it and or modify it under the terms of
4 you should have received a copy of the gnu
lgpl-2.0
2 gnu library general public license (?:version |v )?2(?: 0)?
2 lgpl v?2 0
lgpl-2.1
1 gnu lesser general public license version 2 1 february 1999
2 gnu lesser general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion )?2 1
2 lgpl (?:version |v )?2 1
2 lgplv2 1
2 gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0
1 gnu lesser general public license version 3 29 june 2007
2 gnu lesser general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion )?3(?: 0)?
2 lgpl (?:version |v )?3(?: 0)?
2 lgplv3
2 gnu org licenses lgpl 3 0
lgpl
3 gnu lesser general public license
3 gnu library general public license
3 lesser general public license
3 gnu lgpl
3 licensed under (?:the )?(?:terms of the )?lgpl
3 lgpl licensed
agpl-3.0
1 gnu affero general public license version 3 19 november 2007
2 gnu affero general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion )?3(?: 0)?
2 agpl (?:version |v )?3(?: 0)?
2 agplv3
2 gnu org licenses agpl 3 0
agpl
3 gnu affero general public license
3 affero general public license
3 gnu agpl
3 licensed under (?:the )?(?:terms of the )?agpl
gfdl
1 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 gnu free documentation license version 1 [123]
2 gnu org (?:licenses|copyleft) fdl
3 gnu free documentation license
3 gfdl
mpl-1.1
2 mozilla public license (?:version |v )?1 1
2 mpl (?:version |v )?1 1
2 mozilla org mpl mpl 1 1
mpl-2.0
1 this source code form is subject to the terms of the mozilla public license v 2 0
2 mozilla public license (?:version |v )?2 0
2 mpl (?:version |v )?2 0
2 mozilla org mpl 2 0
2 mozilla org en us mpl 2 0
mpl
3 mozilla public license
epl-1.0
2 eclipse public license (?:version |v )?1 0
2 eclipse org legal epl v10
2 epl 1 0
epl-2.0
1 this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
2 eclipse public license (?:version |v )?2 0
2 eclipse org legal epl (?:v20|2 0)
2 epl 2 0
epl
3 eclipse public license
cddl-1.0
2 common development and distribution license (?:version |v )?1 0
2 cddl (?:version |v )?1 0
cddl-1.1
2 common development and distribution license (?:version |v )?1 1
2 cddl (?:version |v )?1 1
cddl
3 common development and distribution license
cpl-1.0
2 common public license (?:version |v )?1 0
3 common public license
artistic-1.0
2 artistic license (?:version |v )?1 0
artistic-2.0
2 artistic license (?:version |v )?2 0
2 perlfoundation org artistic license 2 0
artistic
3 artistic license
3 same terms as perl itself
bsl-1.0
1 boost software license version 1 0 august 17th 2003
1 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
2 boost software license (?:version |v )?1 0
2 boost org license 1 0
3 boost software license
busl-1.1
2 business source license (?:version |v )?1 1
3 business source license
zlib
1 this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
1 the origin of this software must not be misrepresented you must not claim that you wrote the original software
3 zlib license
3 zlib libpng license
unlicense
1 this is free and unencumbered software released into the public domain
2 unlicense org
3 the unlicense
wtfpl
1 everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
2 do what the fuck you want to public license
3 wtfpl
cc0-1.0
1 the person who associated a work with this deed has dedicated the work to the public domain
2 cc0 1 0
2 creative commons zero(?: v?1 0)?
2 creativecommons org publicdomain zero 1 0
3 cc0
public-domain
2 creativecommons org publicdomain mark 1 0
3 released into the public domain
3 dedicated to the public domain
3 placed in the public domain
4 public domain
cc-by-1.0
2 cc by 1 0
2 creative commons attribution 1 0
2 creativecommons org licenses by 1 0
cc-by-2.0
2 cc by 2 0
2 creative commons attribution 2 0
2 creativecommons org licenses by 2 0
cc-by-2.5
2 cc by 2 5
2 creative commons attribution 2 5
2 creativecommons org licenses by 2 5
cc-by-3.0
2 cc by 3 0
2 creative commons attribution 3 0
2 creativecommons org licenses by 3 0
cc-by-4.0
1 creative commons attribution 4 0 international public license
2 cc by 4 0
2 creative commons attribution 4 0(?: international)?(?: license)?
2 creativecommons org licenses by 4 0
cc-by-sa-3.0
2 cc by sa 3 0
2 creative commons attribution share ?alike 3 0
2 creativecommons org licenses by sa 3 0
cc-by-sa-4.0
1 creative commons attribution sharealike 4 0 international public license
2 cc by sa 4 0
2 creative commons attribution share ?alike 4 0(?: international)?(?: license)?
2 creativecommons org licenses by sa 4 0
cc-by-sa
3 cc by sa
3 creative commons attribution share ?alike
3 creativecommons org licenses by sa
cc-by-nd-4.0
2 cc by nd 4 0
2 creative commons attribution no ?deriv(?:ative)?s 4 0
2 creativecommons org licenses by nd 4 0
cc-by-nd
3 cc by nd
3 creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-3.0
2 cc by nc 3 0
2 creativecommons org licenses by nc 3 0
cc-by-nc-4.0
2 cc by nc 4 0
2 creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
2 creativecommons org licenses by nc 4 0
cc-by-nc
3 cc by nc
3 creative commons attribution non ?commercial
cc-by-nc-sa-4.0
2 cc by nc sa 4 0
2 creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?
2 creativecommons org licenses by nc sa 4 0
cc-by-nc-sa
3 cc by nc sa
3 creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-4.0
2 cc by nc nd 4 0
2 creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?
2 creativecommons org licenses by nc nd 4 0
cc-by-nc-nd
3 cc by nc nd
3 creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by
3 creative commons attribution(?: license)?
3 creativecommons org licenses by
cc
4 creative commons licen[sc]e
4 some rights reserved
eupl-1.1
2 european union public licen[sc]e (?:version |v )?1 1
2 eupl v?1 1
eupl-1.2
2 european union public licen[sc]e (?:version |v )?1 2
2 eupl v?1 2
eupl
3 european union public licen[sc]e
ms-pl
2 microsoft public license
2 ms pl
ms-rl
2 microsoft reciprocal license
2 ms rl
ofl-1.1
1 this font software is licensed under the sil open font license version 1 1
2 sil open font license (?:version |v )?1 1
2 scripts sil org ofl
3 sil open font license
odbl-1.0
2 open database license (?:version |v )?1 0
2 opendatacommons org licenses odbl
3 open database license
odc-by
2 open data commons attribution license
2 opendatacommons org licenses by
pddl-1.0
2 open data commons public domain dedication(?: and)? license
2 opendatacommons org licenses pddl
psf-2.0
1 this license agreement is between the python software foundation
2 python software foundation license(?: version 2)?
3 psf license
php-3.01
2 php license (?:version |v )?3 01
3 php license
ruby
3 ruby license
openssl
1 this product includes software developed by the openssl project
3 openssl license
postgresql
2 postgresql licen[sc]e
ncsa
2 university of illinois ncsa open source license
2 ncsa open source license
upl-1.0
2 universal permissive license (?:version |v )?1 0
3 universal permissive license
w3c
2 w3c software notice and license
3 w3c license
sspl-1.0
2 server side public license
2 sspl v?1 0?
elastic-2.0
2 elastic license (?:version |v )?2 0
3 elastic license
afl-3.0
2 academic free license (?:version |v )?3 0
3 academic free license
osl-3.0
2 open software license (?:version |v )?3 0
3 open software license
ipl-1.0
2 ibm public license (?:version |v )?1 0
qpl-1.0
2 q public license (?:version |v )?1 0
cecill-2.1
2 cecill free software license agreement
3 cecill
vim
3 vim license
json
1 the software shall be used for good not evil
3 json license
beerware
2 the beer ?ware license
proprietary
2 all rights reserved (?:\S+ ){0,12}?unauthori[sz]ed copying
2 unauthori[sz]ed copying of this file via any medium is strictly prohibited
2 proprietary and confidential
3 this software is the confidential and proprietary information of
"""


class Rule(NamedTuple):
    """A signature: matches of `expression` (words joined by blanks) have the label, unless another rule covers them."""

    label: str
    priority: int
    expression: str
    base: bool = False

    @property
    def keyword(self) -> str:
        """The plain letters that the expression begins with."""
        plain = re.match(r"[a-z0-9 ]*", self.expression)[0]
        return plain[:-1] if self.expression[len(plain) : len(plain) + 1] in ("?", "*", "{") and plain else plain


def identifier_rules(labels) -> list[Rule]:
    """For every label with a version or a clause: its declared identifier, with and without `-only` and `-or-later`."""
    found = []
    for label in labels:
        words = " ".join(re.findall("[a-z0-9]+", label))
        found.append(Rule(label, 1, rf"spdx license identifier {words}(?: only| or later)?"))
    return found


def parse(text: str) -> list[Rule]:
    """Rules from lines `priority expression` under a line with their label."""
    rules, label = [], None
    for line in filter(None, map(str.strip, text.splitlines())):
        if line[0].isdigit() and line[1:2] == " ":
            rules.append(Rule(label, int(line[0]), line[2:]))
        else:
            label = line
    return rules


_BASE = [Rule(label, 3, phrase, True) for phrase, label in BASE.items()]
_SIGNED = parse(SIGNATURES)
#: All rules in order: the base phrases first.
RULES: tuple[Rule, ...] = tuple(_BASE + _SIGNED + identifier_rules(dict.fromkeys(r.label for r in _BASE + _SIGNED)))
