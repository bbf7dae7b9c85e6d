"""Signature rules of licences and rights notices.

Fixed values: the licences with their labels, names and addresses, and the sentences in which notices name them. A rule
is a sentence with a licence's name in it, so that rules for a further licence come from one more line.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Label; a text that every name holds; the name as a regular expression; SPDX ids; address, if the licence has one.
LICENSES = [
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache", r"apache\.org/licenses"),
    ("mit", "mit", r"mit(?:/x11)? licen[cs]e", r"mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit-0", r"opensource\.org/licenses?/mit-0"),
    ("x11", "x11", r"x11 licen[cs]e", r"x11", None),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd[- ]2[- ]clause|2[- ]clause bsd|freebsd) licen[cs]e", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd[- ]3[- ]clause|3[- ]clause bsd) licen[cs]e", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd[- ]4[- ]clause|4[- ]clause bsd) licen[cs]e", r"bsd-4-clause", None),
    ("bsd", "bsd", r"bsd(?:[- ]style)? licen[cs]e", r"0bsd", r"opensource\.org/licenses?/bsd"),
    ("isc", "isc", r"isc licen[cs]e", r"isc", r"opensource\.org/licenses?/isc"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,?(?: \(gpl\),?)?(?: version| v\.?)? ?1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,?(?: \(gpl\),?)?(?: version| v\.?)? ?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,?(?: \(gpl\),?)?(?: version| v\.?)? ?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", r"gpl", r"gnu\.org/licenses/gpl"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public licen[cs]e,?(?: version| v\.?)? ?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public licen[cs]e,?(?: version| v\.?)? ?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e,?(?: version| v\.?)? ?3(?:\.0)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl", r"gnu\.org/licenses/agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,?(?: version| v\.?)? ?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/mpl/2\.0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl", r"mozilla\.org/mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,?(?: version| v\.?| -)? ?v?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,?(?: version| v\.?| -)? ?v?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2\.0"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic-1\.0", r"opensource\.org/licenses?/artistic"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e", r"bsl-1\.0", r"boost\.org/license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", r"opensource\.org/licenses?/zlib"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("eupl", "european union public", r"european union public licen[cs]e", r"eupl-1\.[12]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("python-2.0", "python", r"python software foundation licen[cs]e", r"(?:psf|python)-2\.0", r"python\.org/psf/license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[cs]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "nc-nd", r"cc[ -]by-nc-nd(?:[ -][1-4]\.0)?", r"cc-by-nc-nd-[1-4]\.0", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "nc-sa", r"cc[ -]by-nc-sa(?:[ -][1-4]\.0)?", r"cc-by-nc-sa-[1-4]\.0", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "by-nc", r"cc[ -]by-nc(?:[ -][1-4]\.0)?", r"cc-by-nc-[1-4]\.0", r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-nd", "by-nd", r"cc[ -]by-nd(?:[ -][1-4]\.0)?", r"cc-by-nd-[1-4]\.0", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "by-sa", r"cc[ -]by-sa(?:[ -][1-4]\.0)?", r"cc-by-sa-[1-4]\.0", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "by", r"cc[ -]by(?:[ -][1-4]\.0)?(?!-)", r"cc-by-[1-4]\.0", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "sharealike", r"creative commons attribution[- ]share ?alike(?: [1-4]\.0)?", r"", None),
    ("cc-by-nc", "noncommercial", r"creative commons attribution[- ]non-?commercial(?: [1-4]\.0)?", r"", None),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4]\.0)?", r"", None),
]

#: Sentence with {name} or {id} or {url} in it, a text that it holds, priority, confidence.
SENTENCES = [
    (r"spdx-license-identifier: *{id}(?![\w.-])", "spdx-license-identifier", 100, 1.0),
    (r"licen[cs]ed under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", "under", 90, 0.98),
    (r"(?:released|distributed|published|made available|available|provided|shared) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", "under", 90, 0.95),
    (r"subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", "subject to", 85, 0.95),
    (r"you may (?:not )?use this (?:file|work|software) except in compliance with (?:the )?{name}", "compliance", 85, 0.95),
    (r"(?:https?://)?(?:www\.)?{url}\S*", "/", 80, 0.9),
    (r"licen[cs]e: *{name}", "licen", 70, 0.9),
    (r"see (?:the )?{name}", "see", 60, 0.7),
    (r"{name}", "", 50, 0.6),
]

#: Label, pattern, a text that it holds, priority, confidence: notices that name no licence.
NOTICES = [
    ("reserved", r"all rights reserved", "rights reserved", 40, 0.8),
    ("copyright", r"(?:copyright|\(c\)|\xc2\xa9) *(?:\(c\)|\xc2\xa9)? *(?:19|20)\d\d(?: ?- ?(?:(?:19|20)\d\d|present))?", "20", 40, 0.5),
    ("copyright", r"(?:copyright|\(c\)|\xc2\xa9) *(?:\(c\)|\xc2\xa9)? *(?:19)\d\d", "19", 40, 0.5),
    ("public-domain", r"(?:dedicated to|released (?:in)?to|in) the public domain", "public domain", 40, 0.8),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 40, 0.9),
    ("no-redistribution", r"(?:re)?distribution (?:is )?(?:strictly )?prohibited", "prohibited", 40, 0.8),
    ("no-commercial", r"(?:not for|no) commercial use", "commercial use", 40, 0.7),
    ("permission", r"permission is hereby granted, free of charge", "hereby granted", 45, 0.9),
    ("redistribution", r"redistribution and use in source and binary forms", "redistribution", 45, 0.9),
    ("no-warranty", r"without warranty of any kind", "warranty", 30, 0.4),
]

#: Phrases whose words must stand consecutively, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    needs: tuple[str, ...]
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in a fixed order; hundreds of them."""
    found = []
    for label, holds, name, spdx, url in LICENSES:
        for sentence, also, priority, confidence in SENTENCES:
            part, gate = (spdx, "") if "{id}" in sentence else (url, url and url.split("\\")[0]) if "{url}" in sentence else (name, holds)
            if part:
                found.append(Rule(label, r"(?<![\w-])" + sentence.format(id=f"(?:{part})", name=f"(?:{part})", url=part), tuple(x for x in (gate, also) if x), priority, confidence))
    return found + [Rule(label, pattern, (needs,), priority, confidence) for label, pattern, needs, priority, confidence in NOTICES]
