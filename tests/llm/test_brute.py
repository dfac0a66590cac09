"""Added secret kinds, quality verdicts, language profiles and licence lists against plain versions."""
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quire.llm import langid, licenses, quality, secrets
from quire.llm.common import documents

SF_SMALL = "/root/testdata/sf0.001"


def test_all_secret_kinds_equal_a_full_scan(spark):
    rng = random.Random(4)
    bits = ["ghp_" + "a" * 36, "xoxb-1234567890", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "https://me:pass@host", "-----BEGIN PRIVATE KEY-----", "ab\n+/=",
            "-----END PRIVATE KEY-----", "AKIA" + "Z" * 16, "password: hunter22", " ", "\n", "word", "0123456789abcdef" * 2, "eyJ", "gh", "://", "-----"]
    texts = [r["text"] or "" for r in documents(spark, SF_SMALL).collect()] + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = Counter()
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (p, f, g, least) in enumerate(secrets.RULES.values())
                      for m in re.compile(p, f).finditer(t) if m.end(g) - m.start(g) >= least)
        names = list(secrets.RULES)
        found.update(names[k] for _, k, _ in want)
        assert got[i] == ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want), t[:200]
    assert set(found) == set(secrets.RULES)


SCORES = {
    "symbol_share": lambda c: c["n_symbols"] / max(c["word_chars"], 1), "dup_line_share": lambda c: c["n_dup_lines"] / max(c["n_lines"], 1),
    "repeat_share": lambda c: c["n_repeat_words"] / max(c["n_words"], 1), "long_words": lambda c: c["word_chars"] / max(c["n_words"], 1),
    "short_words": lambda c: -c["word_chars"] / max(c["n_words"], 1), "few_words": lambda c: -float(c["n_words"]),
}


def test_quality_verdicts_with_active_cutoffs(spark):
    import math
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < .3
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(10 ** 6)) for _ in range(rng.randint(20, 60))]
        if bad and rng.random() < .8:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "en", None, "xx"])))
        if rng.random() < .9:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    risk, alpha, precision = 0.1, 0.2, 0.8
    counts = {r["doc_id"]: {k[3:]: v for k, v in r.asDict().items() if k.startswith("_q_")} for r in quality.with_stats(docs).collect()}
    lang = {i: g for i, _, g in rows}
    level = alpha / (3 * sum(map(len, quality.GRID.values())))
    chosen = {}
    for g in ("en", None, "xx"):
        own = [(counts[i], y) for i, y in labels if lang[i] == g and not counts[i]["base_failed"]]
        good = [c for c, y in own if y == 1]
        for rule, grid in quality.GRID.items():
            options = []
            for t in grid:
                beyond = [y for c, y in own if SCORES[rule](c) > t]
                k, b = beyond.count(1), beyond.count(0)
                tail = sum(math.comb(len(good), j) * risk ** j * (1 - risk) ** (len(good) - j) for j in range(k + 1))
                if b and b >= precision * (k + b) and tail <= level:
                    options.append((b, t))
            if options:
                chosen[g, rule] = max(options)[1]
    assert any(r == "symbol_share" for _, r in chosen)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, truth, risk=risk, alpha=alpha, precision=precision).collect()}
    want = {i: not (counts[i]["base_failed"] or any(g == lang[i] and SCORES[r](counts[i]) > t for (g, r), t in chosen.items())) for i in counts}
    assert got == want and sum(want.values()) < len(want) - 50
    assert quality.keep_good(docs, truth, risk=risk, alpha=alpha, precision=precision).count() == sum(want.values())


def test_language_profiles_by_plain_loops(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "a cat, a dog", "en"), (4, "die Katze", "de"), (5, "the dog 12", None), (6, "Hund und", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = langid.prototypes(docs.where("lang is not null"))
    letters = langid.Letters()

    def bundle(text):
        v = np.zeros(langid.DIM)
        clean = langid.letters_of(text)
        for i in range(len(clean) - 2):
            g = np.ones(langid.DIM)
            for place in range(3):
                g *= np.roll(letters.of(ord(clean[i + place])), 2 - place)
            v += g
        return v

    sums = defaultdict(lambda: np.zeros(langid.DIM))
    for _, t, g in rows:
        if g:
            sums[g] += bundle(t)
    unit = lambda v: v / np.linalg.norm(v)
    want = np.stack([unit(sums[n]) for n in names])
    assert names == ["de", "en"] and np.allclose(table, want)
    mean = want.mean(axis=0)
    for r in langid.identify(docs, names, table).collect():
        v = unit(bundle(next(t for i, t, _ in rows if i == r["doc_id"]))) - mean
        cos = [v @ (p - mean) / np.linalg.norm(v) / np.linalg.norm(p - mean) for p in want]
        assert r["lang_pred"] == names[int(np.argmax(cos))] and abs(r["score"] - min(1, max(0, max(cos)))) < 1e-5
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, names, table).collect()}
    assert pred[5] == "en" and pred[6] == "de"


def test_every_name_after_every_kind_of_opening():
    """The tree of words against matching the spelt-out sentence itself, for all names and pairs of common ones."""
    spelt = defaultdict(set)
    for n, forms in licenses.NAMES.items():
        for f in forms:
            spelt[tuple(licenses.words(f))].add(n)
    for licence, forms in licenses.NAMES.items():
        for form in forms:
            same = spelt[tuple(licenses.words(form))]
            for opening in ("Licensed under", "This project is licensed under the", "License:", "Distributed under the terms of the"):
                got = {x[2] for x in licenses.match(licenses.sentences(f"Words before.\n{opening} {form}.\nWords after."))}
                assert got and got <= same and licence in same, (opening, form, got)
    common = ["MIT", "Apache-2.0", "BSD-3-Clause", "GPL v3", "MPL 2.0"]
    for a in common:
        for b in common:
            if a != b:
                pair = {x[2] for t in (f"Licensed under {a}.", f"Licensed under {b}.") for x in licenses.match(licenses.sentences(t))}
                assert {x[2] for x in licenses.match(licenses.sentences(f"Dual licensed under {a} and {b}."))} == pair
