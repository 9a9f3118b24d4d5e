"""The signature rules of the license scan, written by hand: identifiers, texts of licenses, notices, grants, names and mentions.

A line is: priority, label, keyword (a word that every match holds), pattern. Patterns are words; `?` behind a word makes it optional, `|` parts
alternatives, `a:b` stands for two words, and a word may be a regular expression of its own.
"""

CONFIDENCE = {100: 1.0, 90: 0.95, 80: 0.95, 70: 0.9, 60: 0.8, 40: 0.7, 20: 0.4}

RULES = r"""
100 mit spdx spdx licen[cs]e identifier mit
100 mit-0 spdx spdx licen[cs]e identifier mit 0
100 apache-2 spdx spdx licen[cs]e identifier apache 2 0
100 apache-1.1 spdx spdx licen[cs]e identifier apache 1 1
100 gpl-3 spdx spdx licen[cs]e identifier gpl 3 0 only|or:later?
100 gpl-2 spdx spdx licen[cs]e identifier gpl 2 0 only|or:later?
100 gpl-1 spdx spdx licen[cs]e identifier gpl 1 0 only|or:later?
100 lgpl-3 spdx spdx licen[cs]e identifier lgpl 3 0 only|or:later?
100 lgpl-2.1 spdx spdx licen[cs]e identifier lgpl 2 1 only|or:later?
100 lgpl-2 spdx spdx licen[cs]e identifier lgpl 2 0 only|or:later?
100 agpl-3 spdx spdx licen[cs]e identifier agpl 3 0 only|or:later?
100 bsd-2-clause spdx spdx licen[cs]e identifier bsd 2 clause
100 bsd-3-clause spdx spdx licen[cs]e identifier bsd 3 clause
100 bsd-4-clause spdx spdx licen[cs]e identifier bsd 4 clause
100 bsd-0 spdx spdx licen[cs]e identifier 0bsd
100 mpl-2 spdx spdx licen[cs]e identifier mpl 2 0
100 mpl-1.1 spdx spdx licen[cs]e identifier mpl 1 1
100 epl-2 spdx spdx licen[cs]e identifier epl 2 0
100 epl-1 spdx spdx licen[cs]e identifier epl 1 0
100 cddl-1 spdx spdx licen[cs]e identifier cddl 1 0|1
100 isc spdx spdx licen[cs]e identifier isc
100 zlib spdx spdx licen[cs]e identifier zlib
100 boost-1 spdx spdx licen[cs]e identifier bsl 1 0
100 busl-1.1 spdx spdx licen[cs]e identifier busl 1 1
100 unlicense spdx spdx licen[cs]e identifier unlicense
100 wtfpl spdx spdx licen[cs]e identifier wtfpl
100 artistic-2 spdx spdx licen[cs]e identifier artistic 2 0
100 python-2 spdx spdx licen[cs]e identifier python|psf 2 0
100 postgresql spdx spdx licen[cs]e identifier postgresql
100 openssl spdx spdx licen[cs]e identifier openssl
100 eupl-1.2 spdx spdx licen[cs]e identifier eupl 1 2
100 ofl-1.1 spdx spdx licen[cs]e identifier ofl 1 1
100 gfdl spdx spdx licen[cs]e identifier gfdl 1 1|2|3
100 cc0 spdx spdx licen[cs]e identifier cc0 1 0
100 cc-by spdx spdx licen[cs]e identifier cc by 4|3|2 0|5
100 cc-by-sa spdx spdx licen[cs]e identifier cc by sa 4|3|2 0|5
100 cc-by-nd spdx spdx licen[cs]e identifier cc by nd 4|3|2 0|5
100 cc-by-nc spdx spdx licen[cs]e identifier cc by nc 4|3|2 0|5
100 cc-by-nc-sa spdx spdx licen[cs]e identifier cc by nc sa 4|3|2 0|5
100 cc-by-nc-nd spdx spdx licen[cs]e identifier cc by nc nd 4|3|2 0|5
100 odbl-1 spdx spdx licen[cs]e identifier odbl 1 0
100 upl-1 spdx spdx licen[cs]e identifier upl 1 0
100 ms-pl spdx spdx licen[cs]e identifier ms pl
100 ms-rl spdx spdx licen[cs]e identifier ms rl
100 elastic-2 spdx spdx licen[cs]e identifier elastic 2 0
100 sspl-1 spdx spdx licen[cs]e identifier sspl 1 0
100 vim spdx spdx licen[cs]e identifier vim
100 ncsa spdx spdx licen[cs]e identifier ncsa
100 afl-3 spdx spdx licen[cs]e identifier afl 3 0
100 osl-3 spdx spdx licen[cs]e identifier osl 3 0
90 mit hereby permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
90 mit copyright the above copyright notice and this permission notice shall be included in all copies or substantial portions
90 mit warranty the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
90 isc permission permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
90 bsd-0 permission permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
90 isc disclaims the software is provided as is and the author|isc disclaims all warranties
90 bsd-3-clause endorse may be used to endorse or promote products derived from this software without specific prior written permission
90 bsd-2-clause redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
90 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display the following acknowledgements{0,1}
90 bsd-2-clause redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
90 bsd-2-clause redistributions redistributions in binary form must reproduce the above copyright notice
90 zlib altered altered source versions must be plainly marked as such and must not be misrepresented as being the original software
90 zlib warranty this software is provided as is without any express or implied warranty in no event will the authors be held liable
90 boost-1 organization permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
90 boost-1 machine unless such copies or derivative works are solely in the form of machine executable object code
90 unlicense unencumbered this is free and unencumbered software released into the public domain
90 wtfpl fuck do what the fuck you want to public licen[cs]e
90 wtfpl fuck you just do what the fuck you want to
90 apache-2 compliance you may not use this file except in compliance with the licen[cs]e
90 apache-2 conditions unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind
90 apache-2 perpetual grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
90 apache-1.1 apache this product includes software developed by the apache software foundation
90 gpl-3 general gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
90 gpl-2 general gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e
90 gpl-2 general under the terms of the gnu general public licen[cs]e version 2 as published by the free software foundation
90 gpl-3 general under the terms of the gnu general public licen[cs]e version 3 as published by the free software foundation
90 lgpl-3 lesser gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
90 lgpl-2.1 lesser gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e
90 lgpl-2 library gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e
90 agpl-3 affero gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
90 gpl warranty this program is distributed in the hope that it will be useful but without any warranty
90 gpl general you should have received a copy of the gnu general public licen[cs]e along with this program
90 lgpl lesser you should have received a copy of the gnu lesser general public licen[cs]e along with this library|program
90 agpl-3 affero you should have received a copy of the gnu affero general public licen[cs]e along with this program
90 mpl-2 mozilla this source code form is subject to the terms of the mozilla public licen[cs]e v?2 0
90 mpl-1.1 mozilla the contents of this file are subject to the mozilla public licen[cs]e version 1 1
90 epl-1 eclipse accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
90 epl-2 eclipse accompanying materials are made available under the terms of the eclipse public licen[cs]e v?2 0
90 cddl-1 development the contents of this file are subject to the terms of the common development and distribution licen[cs]e
90 cddl-1 development subject to the terms of the common development and distribution licen[cs]e
90 gfdl documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
90 artistic-2 verbatim you may distribute verbatim copies of the source form of the standard version
90 openssl openssl this product includes software developed by the openssl project for use in the openssl toolkit
90 ofl-1.1 font this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1
90 postgresql agreement permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
90 cc0 waiving the person who associated a work with this deed has dedicated the work to the public domain by waiving
90 cc-by attribution this work is licen[cs]ed under a creative commons attribution 4|3|2 0|5 international|unported|generic? licen[cs]e
90 cc-by-sa sharealike this work is licen[cs]ed under a creative commons attribution sharealike 4|3|2 0|5 international|unported|generic? licen[cs]e
90 cc-by-sa share this work is licen[cs]ed under a creative commons attribution share alike 4|3|2 0|5 international|unported|generic? licen[cs]e
90 cc-by-nd noderivatives this work is licen[cs]ed under a creative commons attribution noderivatives 4|3|2 0|5 international|unported|generic? licen[cs]e
90 cc-by-nc noncommercial this work is licen[cs]ed under a creative commons attribution noncommercial 4|3|2 0|5 international|unported|generic? licen[cs]e
90 cc-by-nc-sa noncommercial this work is licen[cs]ed under a creative commons attribution noncommercial sharealike 4|3|2 0|5 international|unported|generic? licen[cs]e
90 cc-by-nc-nd noncommercial this work is licen[cs]ed under a creative commons attribution noncommercial noderivatives 4|3|2 0|5 international|unported|generic? licen[cs]e
90 proprietary confidential this software is the confidential and proprietary information of
90 proprietary proprietary unauthori[sz]ed copying of this file via any medium is strictly prohibited proprietary and confidential
90 proprietary reproduced no part of this publication may be reproduced
90 public-domain domain i the copyright holder of this work release this work into the public domain
90 public-domain dedicate to the extent possible under law the authors{0,1} dedicate all copyright
80 mit license licen[cs]ed under the? terms? of? the? mit x11? license
80 mit licence licen[cs]ed under the? terms? of? the? mit x11? licence
80 mit licensed mit licensed
80 mit licenced mit licenced
80 apache-2 apache licen[cs]ed under the? terms? of? the? apache licen[cs]e version? 2 0?
80 apache-2 apache licen[cs]ed under the? apache 2 0? licen[cs]e?
80 apache-2 asl licen[cs]ed under the? asl v?2 0?
80 apache-1.1 apache licen[cs]ed under the? apache software? licen[cs]e version? 1 1
80 gpl-3 general licen[cs]ed under the? terms? of? the? gnu? general public licen[cs]e v3|version:3
80 gpl-3 gpl licen[cs]ed under the? terms? of? the? gnu? gpl v?3|version:3
80 gpl-3 gplv3 licen[cs]ed under the? terms? of? the? gplv3
80 gpl-2 general licen[cs]ed under the? terms? of? the? gnu? general public licen[cs]e v2|version:2
80 gpl-2 gpl licen[cs]ed under the? terms? of? the? gnu? gpl v?2|version:2
80 gpl-2 gplv2 licen[cs]ed under the? terms? of? the? gplv2
80 lgpl-3 lesser licen[cs]ed under the? terms? of? the? gnu? lesser general public licen[cs]e v3|version:3
80 lgpl-3 lgpl licen[cs]ed under the? terms? of? the? gnu? lgpl v?3|version:3
80 lgpl-3 lgplv3 licen[cs]ed under the? terms? of? the? lgplv3
80 lgpl-2.1 lesser licen[cs]ed under the? terms? of? the? gnu? lesser general public licen[cs]e v2|version:2 1
80 lgpl-2.1 lgpl licen[cs]ed under the? terms? of? the? gnu? lgpl v?2|version:2 1
80 agpl-3 affero licen[cs]ed under the? terms? of? the? gnu? affero general public licen[cs]e v3|version:3
80 agpl-3 agpl licen[cs]ed under the? terms? of? the? gnu? agpl v?3|version:3
80 agpl-3 agplv3 licen[cs]ed under the? terms? of? the? agplv3
80 bsd-3-clause bsd licen[cs]ed under the? terms? of? the? new|modified|revised bsd licen[cs]e
80 bsd-3-clause bsd licen[cs]ed under the? bsd 3 clause licen[cs]e?
80 bsd-2-clause bsd licen[cs]ed under the? terms? of? the? simplified bsd licen[cs]e
80 bsd-2-clause bsd licen[cs]ed under the? bsd 2 clause licen[cs]e?
80 mpl-2 mozilla licen[cs]ed under the? terms? of? the? mozilla public licen[cs]e version? 2 0?
80 mpl-2 mpl licen[cs]ed under the? terms? of? the? mpl 2 0?
80 isc isc licen[cs]ed under the? terms? of? the? isc licen[cs]e
80 unlicense unlicense licen[cs]ed under the? terms? of? the? unlicense
80 cc0 cc0 licen[cs]ed under the? terms? of? the? cc0 1? 0?
80 cc-by-nc cc licen[cs]ed under the? terms? of? the? cc by nc
80 cc-by-nc-sa cc licen[cs]ed under the? terms? of? the? cc by nc sa
80 cc-by-nc-nd cc licen[cs]ed under the? terms? of? the? cc by nc nd
80 cc-by-sa cc licen[cs]ed under the? terms? of? the? cc by sa
80 cc-by-nd cc licen[cs]ed under the? terms? of? the? cc by nd
80 cc-by cc licen[cs]ed under the? terms? of? the? cc by 4|3|2 0|5
80 cc-by creative licen[cs]ed under the? terms? of? the? creative commons attribution 4|3|2 0|5
80 cc-by-sa creative licen[cs]ed under the? terms? of? the? creative commons attribution share:alike|sharealike
80 cc-by-nd creative licen[cs]ed under the? terms? of? the? creative commons attribution no:derivatives|noderivatives
80 cc-by-nc creative licen[cs]ed under the? terms? of? the? creative commons attribution non:commercial|noncommercial
80 cc-by-nc-sa creative licen[cs]ed under the? terms? of? the? creative commons attribution non:commercial|noncommercial share:alike|sharealike
80 cc-by-nc-nd creative licen[cs]ed under the? terms? of? the? creative commons attribution non:commercial|noncommercial no:derivatives|noderivatives
70 mit license released|distributed|available|published|provided|offered under the? terms? of? the? mit license
70 mit licence released|distributed|available|published|provided|offered under the? terms? of? the? mit licence
70 apache-2 apache released|distributed|available|published|provided|offered under the? terms? of? the? apache licen[cs]e version? 2 0?
70 gpl-3 general released|distributed|available|published|provided|offered under the? terms? of? the? gnu? general public licen[cs]e v3|version:3
70 gpl-2 general released|distributed|available|published|provided|offered under the? terms? of? the? gnu? general public licen[cs]e v2|version:2
70 gpl general released|distributed|available|published|provided|offered under the? terms? of? the? gnu general public licen[cs]e
70 lgpl lesser released|distributed|available|published|provided|offered under the? terms? of? the? gnu lesser general public licen[cs]e
70 bsd bsd released|distributed|available|published|provided|offered under the? terms? of? the? bsd licen[cs]e
70 mpl-2 mozilla released|distributed|available|published|provided|offered under the? terms? of? the? mozilla public licen[cs]e version? 2 0?
70 cc0 cc0 released|distributed|available|published|provided|offered under the? cc0
70 public-domain domain released|dedicated|placed in:to|into|to|in the public domain
60 apache-2 apache subject|according to the? terms? of? the? apache licen[cs]e version? 2 0?
60 mit license subject|according to the? terms? of? the? mit license
60 mit license under the mit license
60 mit licence under the mit licence
60 mit-0 license mit 0 license
60 mpl-2 mpl subject|according to the? terms? of? the? mpl
60 gpl general subject|according to the? terms? of? the? gnu general public licen[cs]e
40 mit license mit x11? license
40 mit licence mit x11? licence
40 apache-2 apache apache licen[cs]e version? 2 0?
40 apache-2 apache apache 2 0? licen[cs]e
40 apache-1.1 apache apache software licen[cs]e version? 1 1
40 gpl-3 general gnu? general public licen[cs]e v3|version:3
40 gpl-2 general gnu? general public licen[cs]e v2|version:2
40 gpl general gnu general public licen[cs]e
40 lgpl-3 lesser gnu? lesser general public licen[cs]e v3|version:3
40 lgpl-2.1 lesser gnu? lesser general public licen[cs]e v2|version:2 1
40 lgpl lesser gnu lesser general public licen[cs]e
40 agpl-3 affero gnu? affero general public licen[cs]e v3|version:3?
40 bsd-3-clause bsd new|modified|revised bsd licen[cs]e
40 bsd-2-clause bsd simplified bsd licen[cs]e
40 bsd-4-clause bsd original bsd licen[cs]e
40 bsd-2-clause freebsd freebsd licen[cs]e
40 bsd bsd bsd style? licen[cs]e
40 mpl-2 mozilla mozilla public licen[cs]e version? 2 0?
40 mpl-1.1 mozilla mozilla public licen[cs]e version? 1 1
40 epl-2 eclipse eclipse public licen[cs]e version? 2 0?
40 epl-1 eclipse eclipse public licen[cs]e version? 1 0?
40 cddl-1 development common development and distribution licen[cs]e
40 isc isc isc licen[cs]e
40 zlib zlib zlib libpng? licen[cs]e
40 boost-1 boost boost software licen[cs]e version? 1? 0?
40 unlicense unlicense the unlicense
40 artistic-2 artistic artistic licen[cs]e 2 0?
40 artistic-1 artistic artistic licen[cs]e 1 0
40 python-2 python python software foundation licen[cs]e
40 postgresql postgresql postgresql licen[cs]e
40 openssl openssl openssl licen[cs]e
40 eupl-1.2 european european union public licen[cs]e
40 ofl-1.1 sil sil open font licen[cs]e
40 gfdl documentation gnu free documentation licen[cs]e
40 odbl-1 database open database licen[cs]e
40 busl-1.1 business business source licen[cs]e 1? 1?
40 elastic-2 elastic elastic licen[cs]e 2? 0?
40 sspl-1 server server side public licen[cs]e
40 upl-1 universal universal permissive licen[cs]e
40 ms-pl microsoft microsoft public licen[cs]e
40 ms-rl microsoft microsoft reciprocal licen[cs]e
40 ncsa ncsa university of illinois ncsa open source licen[cs]e
40 afl-3 academic academic free licen[cs]e
40 osl-3 software open software licen[cs]e
40 cc-by creative creative commons attribution 4|3|2 0|5
40 cc-by-sa creative creative commons attribution share:alike|sharealike
40 cc-by-nd creative creative commons attribution no:derivatives|noderivatives
40 cc-by-nc creative creative commons attribution non:commercial|noncommercial
40 cc-by-nc-sa creative creative commons attribution non:commercial|noncommercial share:alike|sharealike
40 cc-by-nc-nd creative creative commons attribution non:commercial|noncommercial no:derivatives|noderivatives
40 cc0 creative creative commons zero
40 proprietary rights all rights reserved
40 public-domain domain public domain
20 apache-2 apache apache 2 0?
20 gpl-3 gpl gnu? gpl v?3|version:3
20 gpl-2 gpl gnu? gpl v?2|version:2
20 gpl-3 gplv3 gplv3
20 gpl-2 gplv2 gplv2
20 gpl gpl gnu gpl
20 lgpl-3 lgpl gnu? lgpl v?3|version:3
20 lgpl-2.1 lgpl gnu? lgpl v?2|version:2 1
20 lgpl-3 lgplv3 lgplv3
20 lgpl-2.1 lgplv2 lgplv2 1
20 agpl-3 agpl gnu? agpl v?3|version:3
20 agpl-3 agplv3 agplv3
20 bsd-2-clause bsd bsd 2 clause
20 bsd-3-clause bsd bsd 3 clause
20 bsd-4-clause bsd bsd 4 clause
20 mpl-2 mpl mpl 2 0?
20 mpl-1.1 mpl mpl 1 1
20 epl-2 epl epl 2 0?
20 epl-1 epl epl 1 0?
20 cddl-1 cddl cddl 1? 0?
20 wtfpl wtfpl wtfpl
20 eupl-1.2 eupl eupl 1? 2?
20 ofl-1.1 ofl ofl 1? 1?
20 gfdl gfdl gfdl
20 odbl-1 odbl odbl
20 sspl-1 sspl sspl
20 cc0 cc0 cc0 1? 0?
20 cc-by cc cc by 4|3|2 0|5
20 cc-by-sa cc cc by sa
20 cc-by-nd cc cc by nd
20 cc-by-nc cc cc by nc
20 cc-by-nc-sa cc cc by nc sa
20 cc-by-nc-nd cc cc by nc nd
""".strip().split("\n")
