"""Corpus operators against brute force, round trips and their SQL, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, fingerprint, html, licenses, mixing, quality, queries, sharding, simhash, substring, toxicity
from tests.helpers import rows_of, rows_of_sql

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng=None):
    """Nulls in all columns, empty and very long texts, ties and repeated rows."""
    rng = rng or random.Random(3)
    shared = words(rng, 80)
    texts = ["", None, "one", " \t\n", "a b c", words(rng, 30_000), f"{words(rng, 20)} {shared} {words(rng, 20)}", f"{shared} {words(rng, 5)}", f"x {shared}", "wörd " * 60, "same text here " * 9, "same text here " * 9, "Ünïcode – tést 漢字 😀 " * 7]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (6, "another text under the same id " * 3, None, None, None), (None, shared, None, None, None), (None, None, "de", "s0", 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that the operators use inside or return.
CLASHES = ["k", "th", "g", "b", "at", "fp", "node", "root", "_t", "_k", "_text", "h", "n_tokens", "epoch", "block_rank", "n_words", "n_removed", "kept", "ratio", "score", "evidence", "shard", "depth", "component_id", "kept_text"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


OPERATORS = {
    "fingerprint": fingerprint.compared,
    "substring": lambda df: substring.deduplicated(df, digest=True),
    "bpe": lambda df: bpe.encoded(df, _vocabulary(), bpe.PRE_TOKENS, digest=True),
    "mixing": lambda df: mixing.mixed(df).select("doc_id", "source", "n_tokens", "epoch", "block_rank"),
    "licenses": licenses.scanned,
    "simhash": simhash.near_duplicates,
    "html": lambda df: html.extracted(df, "text", ("doc_id",)),
    "quality": quality.rules,
    "toxicity": lambda df: toxicity.scored(df, toxicity.Lexicon({" bad ": 3.0}, [], 1.0, -2.0)),
    "sharding": lambda df: sharding.sharded(df, 5000),
}


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, odd, empty):
    run = OPERATORS[name]
    once, again = rows_of(run(odd)), rows_of(run(odd.repartition(5)))
    assert once == again and once[1]
    assert rows_of(run(clashing(odd))) == once
    assert rows_of(run(empty))[1] == []
    if name != "mixing":
        assert len(once[1]) == odd.count()


# 1


def jaccard(a, b):
    x, y = Counter(a.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")), Counter(b.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" "))
    return sum((x & y).values()) / sum((x | y).values())


def edited_texts(rows, h):
    """Brute force: of each different (doc_id, text) the edited text and the next text. h: the hash that texts of one id follow by."""
    order = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]), reverse=True)
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        n = len(t)
        out[i, t] = t[: n - n // 2] + nxt[: n // 2], nxt
    return out


def test_fingerprints(spark, odd):
    """A row for each row of the input, those with the same id and different texts among them."""
    rows = awkward() + [(6, "w1 w2 " * 40, None, None, None), (None, "x y", None, None, None), (None, "x y", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    h = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    want = edited_texts(rows, h)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fingerprint.compared(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(((i, len(t or ""), sha(want[i, t or ""][0])) for i, t, *_ in rows), key=str)
    texts = {(i, sha(want[i, t][0])): t for i, t in want}
    prints = {}
    for r in got:
        t = texts[r["doc_id"], r["edited_sha256"]]
        e, nxt = want[r["doc_id"], t]
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(e, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert abs(r["near_edited"] - jaccard(t, e)) < 0.36 and abs(r["near_next"] - jaccard(t, nxt)) < 0.36


def test_fingerprint_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = words(rng, 200, 60)
        cut = rng.randrange(200)
        rows.append((i, base, " ".join(base.split()[:cut] + words(rng, 200 - cut, 60).split())))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    sides = [fingerprint.signatures(df, ["k"], c, 64).withColumnRenamed("signature", c) for c in "ab"]
    got = {r["k"]: r["s"] for r in sides[0].join(sides[1], "k").select("k", fingerprint.likeness("a", "b", 64).alias("s")).collect()}
    errors = [got[k] - jaccard(a, b) for k, a, b in rows]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


# 2


def removed(rows, window):
    """Brute force: of each row its number of words, of removed words, and the kept text."""
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        k = -(2**63) if i is None else i
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, k), k)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        k = -(2**63) if i is None else i
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < k:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def passages(rng, n):
    """Documents that share passages at any place, in part, and words that repeat."""
    pool = [words(rng, rng.randrange(8, 120), 30) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else words(rng, rng.randrange(1, 40), 8 if rng.random() < 0.2 else 3000) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.2:
            parts.append("spam " * rng.randrange(10, 90))
        text = " ".join(parts)
        a = rng.randrange(5)
        rows.append((rng.choice([i, i // 2]), " ".join(text.split()[a:]), "en", "s", 0))
    return rows


@pytest.mark.parametrize(("seed", "window", "gram"), [(1, 50, 12), (2, 20, 7), (3, 6, 6), (4, 5, 1)])
def test_substrings(spark, seed, window, gram):
    rows = passages(random.Random(seed), 70) + awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = substring.deduplicated(df, window=window, gram=gram).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, window)
    digests = substring.deduplicated(df, window=window, gram=gram, digest=True).collect()
    assert sorted(r["kept_sha256"] for r in digests) == sorted(hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in got)


def test_factors_are_of_the_reference(spark):
    """Each factor has a window's words or more and its words stand at its source's place; together they are what is removed."""
    rows = passages(random.Random(7), 60) + awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append((t or "").split(" ") if not (t or "").strip() else t.split())
    order = lambda i: -(2**63) if i is None else i
    for window, gram in ((50, 12), (20, 7)):
        factors = substring.parsed(df, window=window, gram=gram).collect()
        lengths = [f["n_words"] for f in factors]
        assert min(lengths) >= window and max(lengths) > window
        for f in factors:
            assert order(f["source_id"]) < order(f["doc_id"])
            n, own, source = f["n_words"], f["first_word"], f["source_word"]
            stretches = [w[own : own + n] for w in texts[f["doc_id"]]]
            assert any(w[source : source + n] in stretches for w in texts[f["source_id"]])


def test_substring_segments(spark, monkeypatch):
    monkeypatch.setattr(substring, "SEGMENT", 64)
    rng = random.Random(9)
    text = f"{words(rng, 300)} {'y' * 200} {words(rng, 50)}".encode()
    short = substring.word_hashes(text)
    monkeypatch.setattr(substring, "SEGMENT", 1 << 18)
    whole = substring.word_hashes(text)
    assert (short == whole).sum() >= len(whole) - 1  # one word is over the short segment
    assert len(set(whole.tolist())) == len(set(text.split()))


# 3


def test_bpe_is_what_tiktoken_gives(spark, sf_dir, odd):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(_vocabulary())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = ["<|endoftext|>", "  two  spaces ", "a\n\n b\t c  ", "it's  we'll　x", "\x1c a \x85 b", "x " * 3, " a", "a ", "\n a\n", "²x ³", "Ⅷ", "a" * 3000, "'s 't'", "é ab. cd, ef; gh!"]
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    for r in docs.join(bpe.encoded(docs, _vocabulary(), public_tokenizers.PATTERN, keep=("doc_id", "text")), ["doc_id", "text"]).collect():
        assert r["ids"] == theirs.encode_ordinary(r["text"])
        assert bytes(r["decoded"]).decode() == r["text"]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert all(codec.whole.get(k) == i for k, i in ranks.items()) and codec.whole.get(b"not in there") == -1
    assert bpe.Codec(ranks, public_tokenizers.PATTERN + "|zzz").encode("a b  c") == codec.encode("a b  c")


def test_memo_is_bounded_by_bytes():
    memo = bpe.Memo(str.encode, 4000)
    for i in range(500):
        assert memo[f"{i:040d}"] == f"{i:040d}".encode()
        assert memo.held <= 4000
        assert 0 < len(memo) < 4000 / 140
    long = "x" * (bpe.MEMO_CHARS + 1)
    assert memo[long] == long.encode() and long not in memo


# 4, 5, 10


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, sf_dir, duck, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.ORACLES[name])


def test_mix_reaches_its_target(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 20), "en", "hot" if i % 3 else f"s{i % 9}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for mix in (mixing.Mix(entropy=0.9, block=400), mixing.Mix(entropy=1.0, repeats=1.5, block=400), mixing.Mix(entropy=0.95, budget=0.25, block=400)):
        got = mixing.mixed(df, mix)
        use = {r["source"]: (r["t"], r["e"]) for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("epoch").alias("e")).collect()}
        total = sum(t for t, _ in use.values())
        there = Counter(r[3] for r in rows)
        assert total <= mix.budget * 60_000 and total > mix.budget * 60_000 - 20 * len(use) - 20
        assert all(t <= mix.repeats * 20 * there[s] for s, (t, _) in use.items())
        h = -sum(t / total * np.log(t / total) for t, _ in use.values()) / np.log(len(use))
        assert h >= mix.entropy - 0.01 or max(t / (20 * there[s]) for s, (t, _) in use.items()) > mix.repeats - 0.05
        twice = got.groupBy("doc_id", "epoch").count().where("count > 1").count()
        assert twice == 0
    copies = mixing.mixed(df, mixing.Mix(entropy=1.0, repeats=1.5, block=400)).groupBy("source", "doc_id").count().groupBy("source").agg((F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in copies)


def test_licences(spark):
    text = "Redistribution and use in source and binary forms, with or without modification,\tare permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. hello there.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    rows = [(1, text), (2, "\n".join(reversed(text.split(". ")))), (3, "x.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (4, "released under the mit licence")]
    got = {r["doc_id"]: r["licences"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "BSD-2-Clause", 2: "", 3: "CC-BY-NC-4.0,MIT", 4: ""}


BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
GPL = (
    "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
)
#: Official notices, a line a paragraph.
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-2.0-or-later", GPL.format(";", ";", 2)),
    ("GPL-3.0-or-later", GPL.format(":", ",", 3)),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software. If you use this software\n   in a product, an acknowledgment in the product documentation would be\n   appreciated but is not required."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE'),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.mozilla.org/MPL/'),
    ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("EUPL-1.2", 'Licensed under the EUPL, Version 1.2 or \u2013 as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");'),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at: https://openfontlicense.org"),
    ("BSD-4-Clause", BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n  This product includes software developed by the organization.\n\n4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", BSD + "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("curl", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nExcept as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder."),
    ("GFDL-1.3-or-later", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("NTP", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation, and that the name (TrademarkedName) not be used in advertising"),
    ("PSF-2.0", '1. This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.'),
    ("Artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control"),
    ("BlueOak-1.0.0", "## Purpose\n\nThis license gives everyone as much permission to work with this software as possible, while protecting contributors from liability.\n\nThe purpose of this license is to give everyone as much permission to work with this software as possible, while protecting contributors from liability."),
]


@pytest.mark.parametrize("mark, width", [("", None), ("", 72), (" * ", 60), ("# ", 40), ("// ", 76), ("REM ", 50), ("dnl ", 30), (";; ", 25)])
def test_official_notices(spark, mark, width):
    import textwrap

    rows = []
    for i, (_, text) in enumerate(NOTICES):
        lines = [x for line in text.split("\n") for x in (textwrap.wrap(line, width) if width else [line]) or [""]]
        rows.append((i, "\r\n".join(["package x", "", *(mark + x for x in ("Copyright (c) 2024 Somebody", "", *lines)), "", "int x = 1;"])))
    got = {r["doc_id"]: r["licences"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: name for i, (name, _) in enumerate(NOTICES)}


def test_every_known_sentence_is_found(spark):
    """Each of the catalogue's sentences by itself, and each has a hint; each rule's identifiers are known."""
    known = licenses.Catalogue()
    assert all(any(h in s for h in known.hints) for s in known.sentences.values())
    assert {i for _, rule in known.rules for i in rule} <= set(known.sentences) and len({n for n, _ in known.rules}) >= 40
    got = licenses.scanned(spark.createDataFrame(list(known.sentences.items()), "doc_id int, text string")).collect()
    assert all(r["sentence_ids"] == str(r["doc_id"]) for r in got)
    # Rules by themselves: a licence is found unless it is part of another one that the same sentences give.
    rules = [(i, ". ".join(known.sentences[x] for x in rule)) for i, (_, rule) in enumerate(known.rules)]
    for r in licenses.scanned(spark.createDataFrame(rules, "doc_id int, text string")).collect():
        name = known.rules[r["doc_id"]][0]
        found = r["licences"].split(",")
        assert name in found or any((x, name) in known.contains for x in found), name


def test_short_sentences_of_licences_stand_alone(spark):
    texts = ["They say it was released under the MIT License once", "It isn't licensed under CC BY 4.0, they say", "a licensed under the MIT License", "nothing | licensed under the | MIT license"]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [r["sentence_ids"] for r in got] == [""] * len(texts)


def test_tags_and_single_notices(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    texts = {
        "# SPDX-License-Identifier: MIT\nimport os\n": "MIT", "/* SPDX-License-Identifier: Apache-2.0 */": "Apache-2.0", "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;": "GPL-3.0-or-later", "SPDX-License-Identifier: of another kind": "",
        gpl.format(3): "GPL-3.0-or-later", gpl.format(2): "GPL-2.0-or-later", "## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.\n": "", "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "This project is licensed under the Apache License; see the LICENSE.txt file.": "Apache-2.0", "mit": "", "The MIT took it over.": "",
    }
    got = licenses.scanned(spark.createDataFrame(list(texts.items()), "text string, want string"), keep=("text", "want")).collect()
    assert [(r["text"], r["licences"]) for r in got if r["licences"] != r["want"]] == []


def test_sentences_of_a_caller_have_hints(spark):
    """A catalogue whose sentences have none of the usual hints still finds them, in any case and over ends of lines."""
    own = licenses.Catalogue({1: "you may do with this as you please", 2: "the house rules apply"}, [("Own", (1,)), ("House", (2,))], [])
    assert set(own.all_hints()) - set(licenses.HINTS) == {"please", "rules"}
    df = spark.createDataFrame([(1, "You may do with this\nas you PLEASE."), (2, "x\nThe house rules apply!\ny"), (3, "nothing"), (4, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["licences"] for r in licenses.scanned(df, catalogue=own).collect()} == {1: "Own", 2: "House", 3: "", 4: ""}
    assert licenses.Catalogue().all_hints() == list(licenses.HINTS)


def test_shards_fit(spark, odd):
    rng = random.Random(2)
    rows = [(i if i % 3 else 7, "x" * rng.randrange(200)) for i in range(4000)] + [(9001, "y" * 5000), (None, "z" * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.sharded(df, 3000).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
    assert all(sizes[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 3000) != r["oversize"] for r in got)
    assert {r["doc_id"] for r in got if r["oversize"]} == {9001}
    plain = [s for s in sizes if "." not in s]
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)
    # No needless split: two halves of a bucket never fit together.
    for s in plain:
        if s and s[:-1] + ("1" if s[-1] == "0" else "0") in sizes:
            assert sizes[s] + sizes[s[:-1] + ("1" if s[-1] == "0" else "0")] > 3000


def test_shard_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.written(docs, str(tmp_path / "shards"), 60_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 3
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 60000").count() == 0


def test_shard_files_of_repeated_ids(spark, tmp_path):
    """Each row once, within the limit, though an id has more bytes than a shard holds."""
    rows = [(7, f"{i:03d}" * 30) for i in range(40)] + [(7, "x" * 90)] * 5 + [(None, "n" * 50)] * 30 + [(i, "y" * 20) for i in range(100, 160)] + [(9, None), (9, "")]
    df = spark.createDataFrame([(*r, "u", "v") for r in rows], "doc_id bigint, text string, shard string, i string").repartition(4)
    sharding.written(df, str(tmp_path / "shards"), 1000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 1000").count() == 0


# 6


def slow_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, ids, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        k = -(2**63) if ids[i] is None else ids[i]
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] if least[find(i)] != -(2**63) else None for i in range(len(fps))]


def test_simhash(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    fps = [slow_simhash(r["text"]) for r in rows]
    want = sorted(((r["doc_id"], f, c) for r, f, c in zip(rows, fps, components_of(fps, [r["doc_id"] for r in rows], 4))), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    lib = spark.createDataFrame([("a b c d e",)], "t string").select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert simhash.simhash(b"a b c d") == lib % (1 << 64)


@pytest.mark.parametrize(("limit", "distance"), [(4096, 4), (3, 4), (3, 3), (2, 2), (3, 1)])
def test_links_connect_as_all_pairs_do(spark, limit, distance):
    rng = random.Random(limit + distance)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            x = centre
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            if rng.random() < 0.3:
                centre = x
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = simhash.components(simhash.links(df, distance, limit))
    root = {r["node"]: r["root"] for r in found.collect()}
    assert [root.get(x, x) for x in signed] == components_of(fps, signed, distance)


def test_components_of_chains(spark):
    n = 700
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i % 100] + [(5, 5), (1000, 1001), (1001, 1000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    for i in range(n):
        group = order[i // 100 * 100 + 1 : i // 100 * 100 + 101] if i % 100 else order[max(0, i - 99) : i + 1]
        assert got.get(order[i], order[i]) == min(group)
    assert got[1001] == 1000


def test_keep_one_of_each_group_whatever_the_ids(spark, odd):
    """Rows without an id, or with the same one, are different documents if their texts are."""
    rng = random.Random(8)
    texts = [words(rng, 60, 5000) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[1]), (8, texts[4]), (None, texts[5]), (3, texts[5]), (4, texts[4])]]
    got = simhash.keep_one(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (4, texts[4]), (None, texts[5])]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    # One row of each component of the awkward rows.
    rows = odd.collect()
    groups = components_of([slow_simhash(r["text"]) for r in rows], list(range(len(rows))), 4)
    assert simhash.keep_one(spark, odd, "").count() == len(set(groups))


# 7

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="page">
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies on this site, as all sites do.</div>
<!-- <p>no</p> --><article><header><h1>Head &amp; title</h1></header><p><b>First&nbsp;<i>para</i>graph,
 of   some words.<br>Next line<p>x<p>5 &lt; 6 &#8364;</p><form action="/s"><label>Your name</label><input></form><div class="ad">Buy this thing now</div>
<section class="comments"><p>A reader says a lot of things here, in many words and without any link at all.</p></section></article>
<aside><p>Something beside the point that goes on and on for quite a number of words.</p></aside><footer>&copy; 2024 Site</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 50 + "</p><p>ok then</p><p>" + "more " * 40 + "</p><ul><li><a href='x'>link</a><li><a href='y'>link</a></ul>"), (5, "u", "<nav>menu"), (6, "u", "<article>" + "<p>a b</p>" * 30_000)]
    got = {r["page_id"]: r for r in html.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1]["text"] == "Head & title First paragraph, of some words. Next line x 5 < 6 €"
    assert [got[i]["text"] for i in (2, 3, 5)] == ["", "", ""]
    assert got[4]["text"].split() == ["word"] * 50 + ["ok", "then"] + ["more"] * 40
    assert got[6]["text"] == " ".join(["a b"] * 30_000) and got[6]["n_chars"] == len(got[6]["text"])


def test_names_of_the_text_are_not_boilerplate(spark):
    kept = ['<h2 id="related-work">Related work</h2>', '<h3 id="how-to-search">How to search</h3>', '<h3 id="comments">Comments</h3>', '<section id="side-effects"><p>Some people feel dizzy.</p></section>', '<section id="search"><p>How to look for a thing.</p></section>',
            '<div class="ad-hoc-networks"><p>Nodes meet each other.</p></div>', '<div class="notice-period"><p>It is a month.</p></div>', '<p class="share-of-voice">Nearly all.</p>', '<div class="alert_levels long">Five of them.</div>', '<section id="social-history"><p>It began early, and went on for a long time.</p></section>']
    dropped = ['<div class="ad">Buy this</div>', '<section class="comments"><p>A reader says a lot of things here, in many words.</p></section>', '<div class="box related-posts">Other posts</div>', '<div class="search-form">Look for it</div>', '<div id="comments">One reader said so.</div>',
               '<div id="ad-slot-1">Buy that</div>', '<div class="post__share">Tell others</div>', '<div class="cookie-notice">We use them</div>', '<div role="search">Find</div>', '<div class="newsletter-signup-form">Write to us</div>', '<section id="related-articles"><h3 id="more">More to read</h3></section>', "<aside>An aside</aside>"]
    pages = [(i, f"<body><nav><a href='/'>Home</a></nav><article><p>The first words of it all are here.</p>{x}<p>The last words of it all are here.</p></article></body>") for i, x in enumerate(kept + dropped)]
    pages.append((99, "<body><p>" + "word " * 50 + '</p><h2 id="related-work">Related work</h2><p>' + "more " * 50 + "</p></body>"))
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(pages, "page_id bigint, html string"), keep=("page_id",)).collect()}
    import re

    for i, x in enumerate(kept + dropped):
        inside = re.sub("<[^>]+>", "", x) + " " if i < len(kept) else ""
        assert got[i] == f"The first words of it all are here. {inside}The last words of it all are here.", x
    assert "Related work" in got[99]


def test_pages_articles(spark, sf_dir):
    import re
    from html import unescape

    for r in html.op7_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]+>", " ", article)).split())


def test_text_without_marks(spark, sf_dir):
    """Blocks alone tell: all class names are removed, then the tags that say what they hold as well."""
    import re
    from html import unescape

    tree = html.grown(html.LABELLED)
    assert 2 * sum(x[6] == 0 for x, _ in html.LABELLED) >= len(html.LABELLED)
    named = lambda page: re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)
    plain = lambda page: re.sub(r"<(/?)(?:nav|article|footer|aside|header|main)\b", r"<\1div", named(page))
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for strip in (named, plain):
        right = found = wanted = 0
        for page in pages:
            want = Counter(unescape(re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])).split())
            got = Counter(html.main_text(strip(page), tree).split())
            right, found, wanted = right + sum((want & got).values()), found + sum(got.values()), wanted + sum(want.values())
        assert right / found > 0.9 and right / wanted > 0.9


def test_what_is_around_an_article_does_not_remove_it():
    tree = html.grown(html.LABELLED)
    for attrs in ('class="layout has-sidebar"', 'class="page with-sidebar"', 'class="content no-sidebar"', 'class="sidebar"', 'id="comments"', 'class="cookie-notice"'):
        page = f'<body><nav><a href="/">Home</a></nav><div {attrs}><article><h1>Title</h1><p>One two.</p><div class="ad">Buy</div></article></div><footer>End</footer></body>'
        assert html.main_text(page, tree) == "Title One two.", attrs
    long = "word " * 40
    for attrs in ('id="main" class="social-post"', 'class="has-sidebar"', 'class="post share"'):
        assert html.main_text(f'<body><nav><a href="/">Home</a></nav><div {attrs}><p>{long}</p></div></body>', tree) == long.strip(), attrs


def test_comments_and_frames_are_not_the_article():
    tree = html.grown(html.LABELLED)
    said = "A reader says a lot of things here, in many words and without any link at all."
    frames = ['<section id="comments"><article class="comment"><p>{}</p></article></section>', '<div class="comments"><div class="post"><p>{}</p></div></div>', '<section class="reader-feedback"><p>{}</p></section>', '<section id="comments"><article><p>{}</p></article></section>',
              '<aside><div class="entry"><p>{}</p></div></aside>', '<div role="dialog" class="gdpr-consent"><div class="content main"><p>{}</p></div></div>', '<div class="user-comments"><h1>Comments</h1><p>{}</p></div>']
    for article in ("<article><h1>Title</h1><p>One two three.</p></article>", f'<div class="article-body"><h1>Title</h1><p>{"text " * 30}</p></div>'):
        want = " ".join(re.sub("<[^>]+>", " ", article).split())
        for frame in frames:
            assert html.main_text(f'<body><nav><a href="/">Home</a></nav>{article}{frame.format(said)}<footer>End</footer></body>', tree) == want, frame


def test_layout_words_on_wrappers():
    tree = html.grown(html.LABELLED)
    text = "<h1>The heading of it</h1>" + "".join(f"<p>{f'word{i} ' * 40}</p>" for i in range(4))
    for wrapper in ('<div class="page sidebar-left"><div id="c">', '<div class="wrapper right-sidebar"><div>', '<div class="sidebar-wide"><div class="post-content">', '<div id="menu-page"><div>'):
        page = f'<body><nav><a href="/">Home</a></nav>{wrapper}{text}</div></div><footer>End</footer></body>'
        assert html.main_text(page, tree).split() == re.sub("<[^>]+>", " ", text).split(), wrapper
    assert html.main_text("<p>Just one short line.</p>", tree) == "Just one short line."


def test_features_decide_where_names_alone_mark():
    """Blocks decided against their mark: a long paragraph in a box named notice, a list of nothing but links in a post."""
    tree = html.grown(html.LABELLED)
    around = f"<p>{'one ' * 60}</p>"
    notice = f'<div class="post-content"><h1>Head</h1>{around}<div class="notice"><p>{{}}</p></div>{around}</div>'
    links = '<div class="post"><h1>Head</h1>' + around + "<ul>" + "".join(f'<li><a href="/{i}">Story number {i}</a></li>' for i in range(5)) + "</ul></div>"
    marks = {b.text[:4]: b.mark for b in html.blocks(notice.format("two " * 200))}
    assert marks == {"Head": 1, "one ": 1, "two ": -1}
    assert "two" in html.main_text(notice.format("two " * 200), tree) and "two" not in html.main_text(notice.format("two " * 20), tree)
    assert {b.mark for b in html.blocks(links)} == {1} and "number 2" not in html.main_text(links, tree) and "one" in html.main_text(links, tree)


# 8


def slow_quality(text):
    w = (text or "").encode().split()
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_quality(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rng = random.Random(6)
    more = ["x y x y x y x y", "a " * 40, "\n".join(["one line of it"] * 4 + [" ", " "]), "".join(chr(rng.randrange(33, 127)) for _ in range(9000)), " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(8)) for _ in range(900))]
    docs = docs.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(more)], "doc_id bigint, text string"))
    got = docs.withColumn("i", F.monotonically_increasing_id())
    got = common.stored(got)
    out = {r["i"]: r for r in quality.rules(got, keep=("i",)).collect()}
    for r in got.collect():
        o = out[r["i"]]
        assert (o["n_words"], o["word_chars"], o["n_symbols"], o["n_dup_lines"], o["n_repeat_words"], o["base_failed"]) == slow_quality(r["text"])
        assert not (o["base_failed"] and o["kept"])
        if r["text"] == more[4]:
            assert not o["kept"] and not o["base_failed"]


def test_quality_keeps_clean_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    rows = quality.op8_quality(spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if not r["base_failed"])


def slow_kept(text, bands):
    """Brute force of the verdict: whole text, then its chunks, each against the limits of its length."""
    import zstandard

    def fits(part):
        ratio = len(part) / len(zstandard.compress(part, bands.level)) if part else 1.0
        i = max(i for i, size in enumerate(bands.sizes) if size <= len(part))
        return bands.lowest[i] <= ratio <= bands.highest[i]

    data = (text or "").encode()
    parts = [data[i : i + bands.chunk] for i in range(0, len(data), bands.chunk)]
    if len(parts) > 1 and len(parts[-1]) * 2 < bands.chunk:
        parts = [*parts[:-2], parts[-2] + parts[-1]]
    bad = 0 if len(parts) < 2 else len([p for p in parts if not fits(p)])
    return not slow_quality(text)[5] and fits(data) and bad <= bands.share * len(parts)


def test_quality_verdicts(spark, sf_dir, odd):
    rng = random.Random(16)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    spam = "".join(f"w{rng.randrange(9)}### " for _ in range(2000))
    more = [" ".join(noise(7) for _ in range(40)), words(rng, 900, 100_000) + " " + spam[:3000], spam, words(rng, 3000, 100_000) + spam[:4000], words(rng, 9, 9), words(rng, 1400)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").unionByName(odd.select("text")).unionByName(spark.createDataFrame([(t,) for t in more], "text string"))
    verdicts = set()
    tight = quality.Bands(sizes=(0, 500, 4000), lowest=(0.5, 1.2, 1.4), highest=(2.0, 2.3, 2.4))
    for bands in (quality.Bands(), tight, quality._bands(spark, sf_dir)):
        for r in quality.rules(docs, bands=bands, keep=("text",)).collect():
            assert r["kept"] == slow_kept(r["text"], bands)
            verdicts.add((r["kept"], r["base_failed"], r["bad_chunks"] > 0))
    assert verdicts >= {(True, False, False), (True, False, True), (False, False, False), (False, False, True), (False, True, False)}


def test_fitted_bands_separate(spark):
    """Texts of signs among clean ones of all lengths: nearly all clean held-out ones stay, nearly all others of over 1,000
    bytes go (the ratios of shorter ones overlap)."""
    rng = random.Random(21)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "el", "ir")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(3000):
        bad = rng.random() < 0.15
        w = [word() for _ in range(int(20 * 2 ** (rng.random() * 5)))]
        docs.append((i, " ".join(x + rng.choice(["###", "$$$"]) if bad and rng.random() < 0.9 else x for x in w), "en", "s", 0))
        labels.append((i, int(not bad), 0))
    docs, labels = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    bands = quality.fitted(docs, labels)
    rows = quality.rules(docs, bands=bands, keep=("doc_id", "text")).join(labels, "doc_id").where(common.held_out()).where("quality = 1 or quality = 0 and octet_length(text) > 1000").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert share[1] > 0.97 and share[0] < 0.1, share
    assert quality.fitted(docs, labels.limit(0)) == quality.Bands()
    assert quality.fitted(docs.limit(0), labels) == quality.Bands()


# 9


def test_folding():
    for disguised in ("𝓘𝓭𝓲𝓸𝓽", "𝕚𝕕𝕚𝕠𝕥", "ɪᴅɪᴏᴛ", "ⓘⓓⓘⓞⓣ", "ｉｄｉｏｔ", "іԁіоt", "i\u200bdi\u0301ot", "1d10T"):
        assert toxicity.folded(disguised) == toxicity.folded("idiot"), disguised
    for enclosed in ("🄸🄳🄸🄾🅃", "⒤⒟⒤⒪⒯", "🅘🅓🅘🅞🅣", "🅸🅳🅸🅾🆃"):
        assert toxicity.folded(enclosed) == toxicity.folded("idiot"), enclosed
    assert toxicity.folded("a™ b… c€") == " a b c "
    assert toxicity.folded("You 1d10t!! STUPID​, w0rthl3ss") == toxicity.folded("you idiot stupid worthless")
    assert toxicity.folded("Пaр idiοt") .endswith(toxicity.folded("idiot"))


def corpus(rng, n):
    """Documents of which some have words of a lexicon, some of them disguised, and clean ones with an exception phrase."""
    bad = ["zonker", "blarg", "fumpish"]
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 200)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                x = rng.choice(bad)
                w.insert(rng.randrange(len(w)), x if rng.random() < 0.8 else x.replace("o", "0").replace("a", "4").upper())
        elif rng.random() < 0.1:
            w[3:3] = ["hotel", "zonker"]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, tmp_path):
    rows, labels = corpus(random.Random(8), 1500)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    truth = {i: y for i, _, y in labels}
    got = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 1500
    held = [r for r in got if r["held_out"]]
    import zlib

    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    wrong = [r["doc_id"] for r in held if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.02 * len(held), wrong


def test_words_that_are_only_dense_in_toxic_documents(spark, tmp_path):
    """A word beginning that clean documents have now and then: only how dense it is tells."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        w = words(rng, rng.randrange(60, 600)).split()
        often = max(1, len(w) // 40) if toxic else int(rng.random() < 0.3 and len(w) > 200)
        for _ in range(often):
            w.insert(rng.randrange(len(w)), f"vork{rng.choice(['el', 'ant', 'is', 'ul'])}{rng.randrange(200)}")
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    truth = {i: y for i, _, y in labels}
    held = [r for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect() if r["held_out"]]
    caught = [r["predicted"] for r in held if truth[r["doc_id"]]]
    assert sum(caught) >= 0.95 * len(caught)
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) <= 0.03 * len(held)


def test_toxicity_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.learned(odd, labels).weights == {}
    only = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.learned(odd, only).weights == {}
    assert toxicity.learned(empty, only.unionByName(spark.createDataFrame([(3, 1, 0)], only.schema))).weights == {}


# Pipeline


STAGES = {"good": quality.good, "keep_one": simhash.keep_one, "without_passages": substring.without_passages, "to_weights": mixing.to_weights}


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_awkward_rows(name, spark, odd, empty, sf_dir):
    """Columns with the names that the stages use inside, among them a map, come through as they are."""
    more = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in [*CLASHES, "_source", "_tokens", "_order", "_block", "_th", "_h", "c0", "u1", "size", "found", "row", "a.b"]}
    wide = odd.withColumns(more).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    got = STAGES[name](spark, wide, sf_dir)
    assert got.columns == wide.columns and got.dtypes == wide.dtypes
    rows = got.collect()
    plain = STAGES[name](spark, odd.repartition(2), sf_dir).collect()
    assert sorted((tuple(r[c] for c in odd.columns) for r in rows), key=str) == sorted(map(tuple, plain), key=str)
    assert all(r["fp"] == f"fp of {'none' if r['doc_id'] is None else r['doc_id']}" and r["m"] == {"k": r["doc_id"]} for r in rows)
    assert STAGES[name](spark, empty, sf_dir).collect() == []


def test_encode_stage_on_awkward_rows(spark, odd, empty, sf_dir):
    """A row for each row of the input, repeated ones too; null texts are empty; other columns are ignored."""
    import tiktoken

    import corpus_pipeline
    import public_tokenizers

    tokenizer = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(_vocabulary()), special_tokens={})
    got = sorted((tuple(r) for r in corpus_pipeline.encode(spark, clashing(odd), sf_dir).collect()), key=str)
    want = []
    for i, text, _, source, _ in awkward():
        ids = tokenizer.encode_ordinary(text or "")
        want.append((i, source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert corpus_pipeline.encode(spark, empty, sf_dir).collect() == []


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on its own input; the last against tiktoken."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, sf_dir))
        seen[name] = docs.collect()
        if name != "BPE":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    verdict = {r["doc_id"]: r["kept"] for r in quality.op8_quality(spark, sf_dir).collect()}
    assert {r["doc_id"] for r in seen["quality rules"]} == {i for i, ok in verdict.items() if ok}
    rows = seen["quality rules"]
    groups = components_of([slow_simhash(r["text"]) for r in rows], [r["doc_id"] for r in rows], 4)
    assert sorted(r["doc_id"] for r in seen["SimHash near-dedup"]) == sorted(set(groups))
    kept = removed([tuple(r) for r in seen["SimHash near-dedup"]], 50)
    want = {i: t for i, _, n, t in kept if n and t} | {r["doc_id"]: r["text"] for r in seen["SimHash near-dedup"] if r["doc_id"] in {i for i, _, n, _ in kept if not n}}
    assert {r["doc_id"]: r["text"] for r in seen["substring dedup"]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring dedup"])
    mix = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(mix) <= set(want) and max(mix.values()) <= 4
    ranks = bpe.read_ranks(_vocabulary())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: theirs.encode_ordinary(t) for i, t in want.items()}
    assert Counter(r["doc_id"] for r in seen["BPE"]) == mix
    for r in seen["BPE"]:
        assert r["n_tokens"] == len(ids[r["doc_id"]]) and r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(docs)
