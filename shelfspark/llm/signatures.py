"""Signatures of licenses: words of their notices, grants, conditions and disclaimers, in lower case.

Each is written by hand from the public text: label, a word that every match holds, expression. A blank stands for a
gap between words, which may be a line break with the mark of a comment behind it (licenses.GAP), a tilde for any quotation mark.
"""

# Notices by which a work is put under a license; they name it, most with its version.
NOTICES = [
    ("apache-2.0", "apache", r"licensed under the apache license, version 2\.0 \(the ~license~\);? you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group"),
    ("gpl-2.0-or-later", "foundation", r"it under the terms of the gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?,? or \(?at your option\)? any later version"),
    ("gpl-3.0-or-later", "foundation", r"it under the terms of the gnu general public license as published by the free software foundation[;,] either version 3(?: of the license)?,? or \(?at your option\)? any later version"),
    ("gpl-2.0-only", "terms", r"under the terms of the gnu general public license,? version 2,? as published by the free software foundation"),
    ("gpl-2.0-only", "terms", r"under the terms of version 2 of the gnu general public license(?: as published by the free software foundation)?"),
    ("gpl-3.0-only", "terms", r"under the terms of the gnu general public license,? version 3,? as published by the free software foundation"),
    ("gpl-3.0-only", "terms", r"under the terms of version 3 of the gnu general public license(?: as published by the free software foundation)?"),
    ("gpl-2.0-only", "published", r"gnu general public license version 2 as published by the free software foundation"),
    ("lgpl-2.0-or-later", "library", r"under the terms of the gnu library general public license as published by the free software foundation[;,] either version 2(?: of the license)?,? or \(?at your option\)? any later version"),
    ("lgpl-2.1-or-later", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1(?: of the license)?,? or \(?at your option\)? any later version"),
    ("lgpl-3.0-or-later", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3(?: of the license)?,? or \(?at your option\)? any later version"),
    ("lgpl-2.1-only", "lesser", r"under the terms of the gnu lesser general public license,? version 2\.1,? as published by the free software foundation"),
    ("lgpl-2.1-only", "lesser", r"under the terms of version 2\.1 of the gnu lesser general public license"),
    ("lgpl-3.0-only", "lesser", r"under the terms of version 3 of the gnu lesser general public license"),
    ("agpl-3.0-or-later", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation[;,] either version 3(?: of the license)?,? or \(?at your option\)? any later version"),
    ("agpl-3.0-only", "affero", r"under the terms of the gnu affero general public license,? version 3,? as published by the free software foundation"),
    ("agpl-3.0-only", "affero", r"under the terms of version 3 of the gnu affero general public license"),
    ("gfdl-1.1-or-later", "documentation", r"under the terms of the gnu free documentation license, version 1\.1 or any later version published by the free software foundation"),
    ("gfdl-1.2-or-later", "documentation", r"under the terms of the gnu free documentation license, version 1\.2 or any later version published by the free software foundation"),
    ("gfdl-1.3-or-later", "documentation", r"under the terms of the gnu free documentation license, version 1\.3 or any later version published by the free software foundation"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0-no-copyleft-exception", "incompatible", r"this source code form is ~incompatible with secondary licenses~, as defined by the mozilla public license"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license version 1\.1"),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license v1\.0 which accompanies this distribution"),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license (?:v\. ?)?2\.0 which (?:accompanies this distribution|is available at)"),
    ("cpl-1.0", "common", r"made available under the terms of the common public license v1\.0 which accompanies this distribution"),
    ("cddl-1.0", "common", r"the contents of this file are subject to the terms of the common development and distribution license(?:,? version 1\.0)?"),
    ("eupl-1.1", "eupl", r"licensed under the eupl,? (?:version )?v?\.?1\.1"),
    ("eupl-1.2", "eupl", r"licensed under the eupl,? (?:version )?v?\.?1\.2"),
    ("bsl-1.0", "boost", r"distributed under the boost software license, version 1\.0"),
    ("zpl-2.1", "zope", r"this software is subject to the provisions of the zope public license, version 2\.1"),
    ("zpl-2.0", "zope", r"this software is subject to the provisions of the zope public license, version 2\.0"),
    ("php-3.01", "php", r"this source file is subject to version 3\.01 of the php license"),
    ("php-3.0", "php", r"this source file is subject to version 3\.0 of the php license"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl-1.0", "font", r"this font software is licensed under the sil open font license, version 1\.0"),
    ("osl-3.0", "open", r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3\.0"),
    ("afl-2.1", "academic", r"licensed under the academic free license version 2\.1"),
    ("artistic-1.0-perl", "perl", r"under the same terms as perl(?: 5)? itself"),
    ("ms-pl", "microsoft", r"this source is subject to the microsoft public license"),
    ("cecill-2.1", "cecill", r"this software is governed by the cecill license(?: v2\.1)? under french law"),
    ("cecill-b", "cecill-b", r"this software is governed by the cecill-b license under french law"),
    ("cecill-c", "cecill-c", r"this software is governed by the cecill-c license under french law"),
    ("ncsa", "illinois", r"distributed under the university of illinois open source license"),
    ("qpl-1.0", "distributed", r"may be distributed under the terms of the q public license"),
    ("ipl-1.0", "ibm", r"provided under the terms of this ibm public license"),
    ("rpl-1.5", "reciprocal", r"subject to the reciprocal public license(?: version)? 1\.5"),
    ("cpal-1.0", "attribution", r"subject to the common public attribution license version 1\.0"),
    ("apsl-2.0", "apple", r"subject to the apple public source license version 2\.0"),
    ("mulanps-2.0", "mulan", r"licensed under mulan (?:psl|permissive software license),? (?:v|version )?2"),
    ("odbl-1.0", "database", r"made available under the open database license"),
    ("pddl-1.0", "dedication", r"made available under the public domain dedication and license"),
    ("odc-by-1.0", "attribution", r"made available under the open data commons attribution license"),
    ("cc-by-4.0", "attribution", r"licensed under a creative commons attribution 4\.0 international license"),
    ("cc-by-sa-4.0", "sharealike", r"licensed under a creative commons attribution-sharealike 4\.0 international license"),
    ("cc-by-nc-4.0", "noncommercial", r"licensed under a creative commons attribution-noncommercial 4\.0 international license"),
    ("cc-by-nd-4.0", "noderivatives", r"licensed under a creative commons attribution-noderivatives 4\.0 international license"),
    ("cc-by-nc-sa-4.0", "sharealike", r"licensed under a creative commons attribution-noncommercial-sharealike 4\.0 international license"),
    ("cc-by-nc-nd-4.0", "noderivatives", r"licensed under a creative commons attribution-noncommercial-noderivatives 4\.0 international license"),
    ("cc-by-3.0", "unported", r"licensed under a creative commons attribution 3\.0 unported license"),
    ("cc-by-sa-3.0", "unported", r"licensed under a creative commons attribution-share ?alike 3\.0 unported license"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("ogl-uk-3.0", "government", r"licensed under the open government licence v3\.0"),
    ("ogl-uk-2.0", "government", r"licensed under the open government licence v2\.0"),
    ("gutenberg", "gutenberg", r"under the terms of the (?:full )?project gutenberg[™\s(tm)-]*license"),
]

# Words of the licenses themselves.
TEXTS = [
    ("mit", "charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "sublicense", r"the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", r"the software is provided ~as is~, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("mit", "dealings", r"arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("mit-0", "charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the ~software~\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("x11", "consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("x11", "dealings", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization"),
    ("hpnd", "fee", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("hpnd-sell", "sell", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose"),
    ("isc", "fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", "fee", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "disclaimed", r"the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:(?!nor the names? of|neither the names? of)[^:;{}])*+nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause-uc", "california", r"this product includes software developed by the university of california, berkeley and its contributors"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party~?s patent rights are granted by this license"),
    ("bsd-2-clause-patent", "irrevocable", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"),
    ("bsd-2-clause-freebsd", "freebsd", r"should not be interpreted as representing official policies, either expressed or implied, of the freebsd project"),
    ("zlib", "as-is", r"this software is provided ~as-is~, without any express or implied warranty"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("libpng", "png", r"the png reference library is supplied ~as is~"),
    ("curl", "fee", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:(?!the freetype project|portions of this)[^:;{}])*+the freetype project"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("php", "php", r"products derived from this software may not be called ~php~"),
    ("ruby", "object", r"you may distribute the software in object code or binary form, provided that you do at least one of the following"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "authors", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose"),
    ("postgresql", "agreement", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ncsa", "deal", r"to deal with the software without restriction, including without limitation the rights to use, copy"),
    ("afmparse", "retained", r"may be used, copied, and distributed for any purpose and without charge, with or without modification, provided that all copyright notices are retained"),
    ("icu", "unicode", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("unicode-dfs", "unicode", r"the unicode data files or unicode software, or any portion thereof, without restriction"),
    ("w3c", "royalty", r"permission to copy, modify, and distribute this (?:software|work) and its documentation, with or without modification, for any purpose and without fee or royalty"),
    ("beerware", "beer", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer"),
    ("wtfpl", "fuck", r"do what the fuck you want to public license"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "heirs", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc0-1.0", "cc0", r"cc0 1\.0 universal"),
    ("cc-by-4.0", "attribution", r"creative commons attribution 4\.0 international public license"),
    ("cc-by-sa-4.0", "sharealike", r"creative commons attribution-sharealike 4\.0 international public license"),
    ("cc-by-nc-4.0", "noncommercial", r"creative commons attribution-noncommercial 4\.0 international public license"),
    ("cc-by-nd-4.0", "noderivatives", r"creative commons attribution-noderivatives 4\.0 international public license"),
    ("cc-by-nc-sa-4.0", "sharealike", r"creative commons attribution-noncommercial-sharealike 4\.0 international public license"),
    ("cc-by-nc-nd-4.0", "noderivatives", r"creative commons attribution-noncommercial-noderivatives 4\.0 international public license"),
    ("cc", "creative", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "creative", r"the work \(as defined below\) is provided under the terms of this creative commons public license"),
    ("cc", "creative", r"some rights reserved\.? creative commons"),
    ("apache-2.0", "apache", r"apache license version 2\.0, january 2004"),
    ("apache-2.0", "derivative", r"grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of"),
    ("apache-2.0", "basis", r"distributed on an ~as is~ basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "1991", r"gnu general public license version 2, june 1991"),
    ("gpl-3.0", "2007", r"gnu general public license version 3, 29 june 2007"),
    ("gpl-1.0", "1989", r"gnu general public license version 1, february 1989"),
    ("gpl", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl", "hope", r"distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl"),
    ("gpl-with-classpath-exception", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-with-gcc-exception", "gcc", r"under section 7 of gpl version 3, you are granted additional permissions described in the gcc runtime library exception"),
    ("gpl-with-autoconf-exception", "configuration", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-with-bison-exception", "bison", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("linux-syscall-note", "kernel", r"does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("lgpl-2.0", "1991", r"gnu library general public license version 2, june 1991"),
    ("lgpl-2.1", "1999", r"gnu lesser general public license version 2\.1, february 1999"),
    ("lgpl-3.0", "2007", r"gnu lesser general public license version 3, 29 june 2007"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", "hope", r"distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu (?:lesser|library) general public license"),
    ("lgpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl"),
    ("agpl-3.0", "2007", r"gnu affero general public license version 3, 19 november 2007"),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl", "network", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/agpl"),
    ("gfdl", "invariant", r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("gfdl", "invariant", r"with the invariant sections being list their titles"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/mpl/2\.0"),
    ("mpl", "world-wide", r"each contributor hereby grants you a world-wide, royalty-free, non-exclusive license"),
    ("epl", "eclipse", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("edl-1.0", "eclipse.org", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl", "opensolaris", r"opensolaris\.org/os/licensing"),
    ("bsl-1.0", "machine-executable", r"in the form of machine-executable object code generated by a source language processor"),
    ("bsl-1.0", "boost.org", r"boost\.org/license_1_0\.txt"),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied, modified, distributed"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test"),
    ("ofl", "font", r"the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces"),
    ("ofl-1.1", "2007", r"sil open font license version 1\.1 - 26 february 2007"),
    ("ofl", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("upl-1.0", "collectively", r"a copy of this software, associated documentation and/or data \(collectively the ~software~\), free of charge and under any and all copyright rights"),
    ("sspl-1.0", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "production", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("commons-clause", "licensor", r"the software is provided to you by the licensor under the license, as defined below, subject to the following condition"),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform noncommercial license 1\.0\.0"),
    ("openrail", "use-based", r"use-based restrictions as referenced in paragraph 5"),
    ("llama", "meta", r"you are granted a non-exclusive, worldwide, non-transferable and royalty-free limited license under meta"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("cc-pddc", "dedicator", r"the person or persons who have associated work with this document \(the ~dedicator~"),
    ("nist-pd", "title", r"pursuant to title 17,? section 105,? (?:of the )?united states code"),
    ("us-government", "government", r"(?:is|are) a work of the (?:united states|u\.s\.) government"),
    ("us-government-rights", "government", r"u\.s\. government users restricted rights"),
    ("crown-copyright", "crown", r"crown copyright"),
    ("gutenberg", "anywhere", r"this (?:ebook|etext) is for the use of anyone anywhere"),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:1[89]|20)[0-9]{2}"),
    ("copyright", "©", r"©\s*(?:copyright\s*)?(?:1[89]|20)[0-9]{2}"),
    ("copyright", "copyrighted", r"this (?:work|material|document|publication) is copyrighted"),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "trade", r"contains (?:confidential information and )?trade secrets of"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)(?:(?!prohibited|unauthorized)[a-z,\s])*+prohibited"),
    ("proprietary", "license", r"use of this software is (?:governed by|subject to) (?:the terms of )?(?:a|the) (?:commercial )?license agreement"),
    ("no-reuse", "reproduced", r"no part of this (?:publication|work|book) may be reproduced"),
    ("no-reuse", "reproduced", r"may not be reproduced, (?:stored|distributed|transmitted)(?:(?!without (?:the )?(?:prior )?written|may not be reproduced)[a-z,\s])*+without (?:the )?(?:prior )?written (?:permission|consent)"),
    ("no-reuse", "personal", r"for personal(?:,| and) non-?commercial use only"),
    ("no-training", "used", r"may not be used (?:to train|for (?:the )?training(?: of)?) (?:any )?(?:machine learning|artificial intelligence|ai|large language)"),
    ("no-training", "mining|scraping", r"(?:text and data mining|data mining|scraping) (?:is|are) (?:strictly |expressly )?(?:prohibited|forbidden|not permitted|reserved)"),
    ("with-permission", "permission", r"(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission (?:of|from)"),
    ("public-domain", "claimed", r"no copyright is claimed (?:in|on|for)"),
    ("public-domain", "domain", r"(?:this (?:work|file|software|code|text) is|has been placed|hereby placed|been released) (?:in|into) the public domain"),
]

# Identifiers of licenses that a machine-readable tag may name besides the families and versions.
IDENTIFIERS = """
0bsd aal afl-3.0 apsl-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause cal-1.0 cc-pddc cecill-2.1 cecill-b cecill-c clartistic
cpal-1.0 curl dco ecos-2.0 edl-1.0 efl-2.0 ftl gutenberg hpnd hpnd-sell-variant icu ijg imagemagick intel ipl-1.0 json libpng libpng-2.0 linux-openib lppl-1.3c mit-0 miros mit-modern-variant motosoto
mulanpsl-2.0 naist-2003 ngpl nist-pd noweb npl-1.1 ntp ogl-uk-3.0 oldap-2.8 openssl parity-7.0.0 pddl-1.0 polyform-noncommercial-1.0.0 postgresql python-2.0 qpl-1.0 rpl-1.5 rpsl-1.0 ruby sax-pd
sendmail sgi-b-2.0 simpl-2.0 sleepycat spl-1.0 ssh-openssh sugarcrm-1.1.3 tcl ubuntu-font-1.0 unicode-3.0 unicode-dfs-2016 vim vsl-1.0 watcom-1.0 x11 xfree86-1.1 xnet ypl-1.1 zend-2.0 zimbra-1.4
""".split()

# Exceptions that a tag may name after WITH.
EXCEPTIONS = """
autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception ocaml-lgpl-linking-exception openvpn-openssl-exception
qt-lgpl-exception-1.1 u-boot-exception-2.0 wxwindows-exception-3.1
""".split()
