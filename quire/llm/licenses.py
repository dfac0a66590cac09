"""License scans by sentence rules.

A text is cut at line ends and at . ! ? ; : before white space. A known sentence
is a sequence of words (letters and digits only, any case, comment marks gone) that begins and
ends at such cuts; cuts inside it do not count, so wrapped lines and "License: MIT" are
whole. Known sentences have an identifier: ``SENTENCES`` lists whole sentences of licence
texts, ``NAMES`` the names of licences, alone or after ``OPENINGS``. Each other
stretch between cuts is an unknown sentence. An SPDX line is a sentence with the identifiers of its expression.
A licence rule is an ordered list of identifiers; it matches where its identifiers occur in that
order with at most ``GAP`` unknown sentences between neighbours. Longer rules
are tried first and use up their sentences. Names joined by "and" or "or" after an opening give each of their licences; reserved rights
count as proprietary only where nothing else is found. Row-wise work: no shuffle.

Defined results: null or empty texts have no licence; repeated rows get the same
answer; an empty table gives no rows; other columns are never read.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import beside, documents

GAP = 2
#: Identifier -> whole sentences of licence texts that stand for it.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
                  "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
                   "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
              "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"],
    "apache-name": ["Licensed under the Apache License, Version 2.0 (the \"License\")", "Apache License Version 2.0, January 2004"],
    "apache-use": ["you may not use this file except in compliance with the License", "you may not use this software except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "gpl-free": ["This program is free software", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": [f"Neither the name of {who} may be used to endorse or promote products derived from this software without specific prior written permission"
                    for who in ("the copyright holder nor the names of its contributors", "the copyright holders nor the names of its contributors", "the copyright holder nor the names of any contributors",
                                "the University nor the names of its contributors", "the author nor the names of its contributors", "the organization nor the names of its contributors", "the <organization> nor the names of its contributors")],
    "isc-grant": [f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and/or", "and")],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-grant": [f"This Source Code Form is subject to the terms of the Mozilla Public License, {x} 2.0" for x in ("v.", "version")],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-grant": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "public-domain": ["This work is in the public domain", "This software is in the public domain", "Released into the public domain", "Placed in the public domain"],
    "reserved": ["All rights reserved"],
}
#: Licence -> names. Those that say what they are also stand alone; others count after an opening.
NAMES = {
    "MIT": ["MIT License", "MIT License (MIT)", "MIT", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache Software License 2.0", "Apache 2.0", "Apache-2.0", "Apache 2", "Apache License 2"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD 2-Clause \"Simplified\" License"],
    "ISC": ["ISC License", "ISC", "ISC License (ISC)"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD"],
    "MPL-2.0": [f"{n} {v}" for n in ("Mozilla Public License", "Mozilla Public License,", "MPL") for v in ("2.0", "version 2.0", "v2.0", "v. 2.0")] + ["MPLv2", "Mozilla Public License 2.0 (MPL 2.0)"],
    **{f"EPL-{v}": [f"Eclipse Public License{x} {v}" for x in ("", " -", " - v", " version")] + [f"Eclipse Public License v{v}", f"EPL {v}", f"EPL v{v}"] for v in ("1.0", "2.0")},
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL 1.0"], "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense"], "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"], "Artistic-2.0": ["Artistic License 2.0"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License", "ODbL", "ODbL 1.0"], "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2", "European Union Public Licence v. 1.2"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"],
    "Python-2.0": ["Python Software Foundation License", "PSF License"],
}
_GNU = {"GPL": ("General Public License", {"1": "", "2": "June 1991", "3": "29 June 2007"}), "LGPL": ("Lesser General Public License", {"2.1": "February 1999", "3": "29 June 2007"}),
        "AGPL": ("Affero General Public License", {"3": "19 November 2007"}), "GFDL": ("Free Documentation License", {"1.1": "", "1.2": "", "1.3": ""})}
for _k, (_long, _versions) in _GNU.items():
    NAMES[_k] = [f"GNU {_long}", f"GNU {_k}", _k]
    for _v, _day in _versions.items():
        _forms = [f"{n} {x}" for n in (f"GNU {_long}", f"GNU {_long} ({_k})", f"GNU {_k}", _k) for y in {_v, f"{_v}.0" if "." not in _v else _v} for x in (y, f"v{y}", f"v. {y}", f"version {y}", f"v{y} ({_k}v{y})")]
        _forms += [f"version {_v} of the GNU {_long}", f"GNU {_k}v{_v}", f"{_k}v{_v}", f"GNU {_long} version {_v}, {_day}"]
        NAMES[f"{_k}-{_v}" + ("" if "." in _v else ".0")] = [f"{n} {x}" for n in _forms for x in ("", "only", "or later", "or newer", "or any later version", "or (at your option) any later version")]
        SENTENCES[f"{_k.lower()}{_v}-grant"] = [f"you can redistribute it and/or modify it under the terms of the GNU {_long} as published by the Free Software Foundation, {x}" for x in (
            f"either version {_v} of the License, or (at your option) any later version", f"version {_v} of the License", f"version {_v}", f"either version {_v} of the License, or any later version")]
for _k, _long in {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}.items():
    _longs = {f"Creative Commons Attribution{x}" for x in (_long, _long.replace("-Share", "-Share ").replace("Commercial", "commercial"), _long.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share-Alike").replace("NoDerivatives", "No-Derivatives"), _long.replace("NoDerivatives", "NoDerivs"))}
    for _v in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
        _forms = [f"{n} {x}" for n in _longs for x in ([_v, f"{_v} International", f"{_v} Unported", f"{_v} Generic"] if _v else [""])] + [f"CC BY{_k} {x}" for x in ([_v, f"{_v} International"] if _v else [""])]
        NAMES[f"CC-BY{_k}" + (f"-{_v}" if _v else "")] = [f"{n} {x}" for n in _forms for x in ("", "License", "Public License")]
#: Openings of a licence statement, (subject, verb), and what may follow the name.
SUBJECTS = ["", "license", "license osi approved", *[f"{a} {n} {v}" for a in ("this", "the", "all", "our") for n in (
    "work", "project", "software", "program", "code", "source code", "file", "document", "documentation", "package", "library", "module", "repository", "text", "article", "content", "material", "data", "dataset", "site", "image", "book", "page") for v in ("is", "are")]]
VERBS = [f"{v} under" for v in ("licensed", "released", "distributed", "available", "made available", "published", "provided", "dual licensed", "shared")] + ["subject to", "covered by", "governed by"]
ENDINGS = ["see LICENSE for details", "see LICENSE file for details", "see the LICENSE file for details", "see the LICENSE file", "see LICENSE", "see LICENSE.md for details", "see the LICENSE.md file for details",
           "see LICENSE for more information", "unless otherwise noted", "unless otherwise stated"]
#: Licence rules, (name, ordered identifiers).
RULES = [
    ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is"]), ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    *[("MIT", [*name, "reserved", "mit-grant", "mit-notice", *end]) for name in ([], ["mit-name"]) for end in ([], ["as-is"])],
    ("Apache-2.0", ["apache-name", "apache-use", "apache-copy"]), ("Apache-2.0", ["apache-use", "apache-copy"]),
    ("GPL", ["gpl-free"]), *[(n, [*free, f"{k.lower()}{v}-grant"]) for k, (_, of) in _GNU.items() for v in of for n in [f"{k}-{v}" + ("" if "." in v else ".0")] for free in ([], ["gpl-free"])],
    *[(f"BSD-{2 + len(end)}-Clause", [*name, *first, "bsd-grant", "bsd-source", "bsd-binary", *end])
      for end in ([], ["bsd-endorse"]) for first in ([], ["reserved"]) for name in ([], [f"bsd-{2 + len(end)}-clause-name"])],
    ("ISC", ["isc-grant"]), ("ISC", ["isc-name", "isc-grant"]), ("0BSD", ["0bsd-grant"]), ("MPL-2.0", ["mpl-grant"]), ("Unlicense", ["unlicense-grant"]), ("Zlib", ["zlib-grant"]), ("BSL-1.0", ["boost-grant"]),
    ("Public-Domain", ["public-domain"]), ("Proprietary", ["reserved"]),
]
IDENTIFIER = {"Apache-2.0": "apache-name"}
RULES += [(n, [IDENTIFIER.get(n, f"{n.lower()}-name")]) for n in NAMES]
SENTENCE = re.compile(r"(?:[^\n.!?;:]|[.!?;:](?![\s\"]|$))+")
WORD = re.compile(r"[^\W_]+")
#: A list number ("1.", "(a)", "iv)") or a comment word before a sentence.
LEAD = re.compile(r"[\W_]*(?:\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|rem\b|dnl\b)(?=\s)", re.I)
_SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = re.compile(rf"SPDX-License-Identifier[ \t]*:?[ \t]*(\(*[ \t]*{_SPDX_ID}(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+{_SPDX_ID})*\)*)", re.I)
SPELT = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def words(text: str, start: int = 0, end: int | None = None):
    """The words of a part of a text, lower case, British spelling of licence as American."""
    for m in WORD.finditer(text, start, len(text) if end is None else end):
        w = m.group().lower()
        yield SPELT.get(w, w)


def _known() -> dict:
    """Tree of words; under None the identifier of the sentence that ends there."""
    def put(tree: dict, sentence: str, identifier=None, then: dict | None = None) -> None:
        *head, last = words(sentence)
        for w in head:
            tree = tree.setdefault(w, {})
        if then is None:
            tree.setdefault(last, {})[None] = identifier
        else:
            tree[last] = {**tree.get(last, {}), **then}

    def ends(tree: dict) -> None:
        for t in [t for t in tree.values() if isinstance(t, dict)]:
            ends(t)
        if None in tree:
            for e in ENDINGS:
                put(tree, e, tree[None])

    names: dict = {}
    root: dict = {}
    for n, forms in NAMES.items():
        for f in forms:
            i = IDENTIFIER.get(n, f"{n.lower()}-name")
            put(names, f, i)
            if re.search(r"licen[sc]e\b|creative commons", f, re.I):
                put(root, f, i)
                put(root, f"the {f}", i)
    ends(names)
    some = {**names, "a": names, "an": names, "the": {**names, "terms": {"of": {**names, "the": names}}}, "terms": {"of": {**names, "the": names}}}
    under = {**some, "either": {**some, "of": some}, "both": some}
    openings = [f"{s} {v}" for s in SUBJECTS for v in VERBS] + [f"{s} under" for s in SUBJECTS if s.endswith((" is", " are"))] + ["license", "license osi approved"]
    for o in sorted(openings, key=lambda o: -len(o.split())):
        put(root, o, then=under)
    for i, forms in SENTENCES.items():
        for f in forms:
            # Branches that openings share are copied on the way.
            tree = root
            for w in words(f):
                tree[w] = dict(tree.get(w, {}))
                tree = tree[w]
            tree[None] = i
    return root, some


KNOWN, LISTED = _known()
#: Identifier of a name -> its licence.
LICENCE_OF = {IDENTIFIER.get(n, f"{n.lower()}-name"): n for n in NAMES}


def _longest(text: str, cuts: list[tuple[int, int]], k: int, start: int) -> tuple[int, str] | None:
    """(last stretch, identifier) of the longest known sentence that begins at ``start`` of stretch k.

    After a licence's name "and" or "or" may lead to another name: the identifier is then a list of names.
    """
    states, best = [(KNOWN, "")], None
    for j in range(k, len(cuts)):
        for w in words(text, start if j == k else cuts[j][0], cuts[j][1]):
            ahead = [(tree[w], held) for tree, held in states if w in tree]
            if w in ("and", "or"):
                ahead += [(LISTED, f"{held} {tree[None]}") for tree, held in states if tree.get(None) in LICENCE_OF]
            if not ahead:
                return best
            states = ahead
        ended = [f"list{held} {tree[None]}" if held else tree[None] for tree, held in states if None in tree and (not held or tree[None] in LICENCE_OF)]
        if ended:
            best = j, ended[0]
    return best


def _plain(text: str, start: int, end: int) -> list[tuple[int, int, str | None]]:
    cuts = [m.span() for m in SENTENCE.finditer(text, start, end) if WORD.search(text, *m.span())]
    out, k = [], 0
    while k < len(cuts):
        s, e = cuts[k]
        hit = _longest(text, cuts, k, s)
        if hit is None and (lead := LEAD.match(text, s, e)):
            hit = _longest(text, cuts, k, lead.end())
        last, identifier = hit or (k, None)
        out.append((s, cuts[last][1], identifier))
        k = last + 1
    return out


def sentences(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, identifier or None) of each sentence that has a word."""
    out, at = [], 0
    for m in SPDX.finditer(text):
        ids = re.findall(_SPDX_ID, re.sub(rf"\bWITH[ \t(]+{_SPDX_ID}", "", m[1], flags=re.I))
        ids = [re.sub(r"(?i)(-only|-or-later|\+)$", "", x) for x in ids if x.upper() not in ("AND", "OR")]
        out += [*_plain(text, at, m.start()), (*m.span(), "spdx " + " ".join(dict.fromkeys(ids)))]
        at = m.end()
    return out + _plain(text, at, len(text))


def match(found: list[tuple[int, int, str | None]], rules=RULES, gap: int = GAP) -> list[tuple[int, int, str]]:
    """(start, end, licence) of matched rules in text order; longer rules first."""
    known = [k for k, x in enumerate(found) if x[2]]
    used, out = set(), []
    there = {found[k][2] for k in known}
    out += [(found[k][0], found[k][1], name) for k in known if found[k][2].startswith("spdx ") for name in found[k][2].split()[1:]]
    out += [(found[k][0], found[k][1], LICENCE_OF[i]) for k in known if found[k][2].startswith("list ") for i in found[k][2].split()[1:]]
    for name, ids in sorted((r for r in rules if there.issuperset(r[1])), key=lambda r: -len(r[1])):
        for k, first in enumerate(known):
            chain, at = [], k
            for want in ids:
                while at < len(known) and (known[at] in used or found[known[at]][2] != want) and chain and known[at] - chain[-1] <= gap:
                    at += 1
                if at == len(known) or known[at] in used or found[known[at]][2] != want or chain and known[at] - chain[-1] > gap + 1:
                    chain = []
                    break
                chain.append(known[at])
                at += 1
            if chain:
                used.update(chain)
                out.append((found[first][0], found[chain[-1]][1], name))
    # "All rights reserved" beside a licence says nothing of its own.
    return sorted(x for x in out if x[2] != "Proprietary" or all(y[2] == "Proprietary" for y in out))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known_sentences, licenses (sorted names, comma-joined), spans (licence:start:end)."""
    def make():
        def run(texts):
            out: dict[str, list] = {"n_known_sentences": [], "licenses": [], "spans": []}
            for t in texts:
                found = sentences(t or "")
                hits = match(found)
                out["n_known_sentences"].append(sum(x[2] is not None for x in found))
                out["licenses"].append(",".join(sorted({h[2] for h in hits})))
                out["spans"].append(",".join(f"{n}:{s}:{e}" for s, e, n in hits))
            return out
        return run

    return beside(docs, make, "n_known_sentences long, licenses string, spans string")


def op7_license_scan(spark, sf_dir) -> DataFrame:
    return scan(documents(spark, sf_dir))
