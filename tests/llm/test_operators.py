"""The training-data operators against plain definitions, and their defined results for odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import chat, language, mixing, nearcopies, packing, queries, radix, substrings, threshold, toxicity, warc
from strideframe.llm.shared import components, new_path

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, `group` int, draw string, key string, component string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x", "y", "z") for i, t, s in rows], DOCS)


def sample_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeghé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 5, 30, 120, 300]))) for _ in range(40)]
    for i in range(12):
        w = texts[30 + i % 4].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append("\n".join(w))
    texts += [texts[3] + " ", texts[3], " " + texts[3], "", None, " \t ", "Ünïcode only", texts[20] * 8, "x" * 199, "y" * 200, "z" * 450, "ab" * 300]
    return [(i * 3 + 1, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(3, "doc_id").cache()


# exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_duplicates(docs, rows):
    for options in ({}, {"head": 1, "first": 2, "growth": 2, "widest": 64}):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in radix.exact_duplicates(docs, **options).collect()}
        assert got == brute_exact(rows)


def test_exact_duplicates_odd_rows(spark):
    rows = [(None, "a", None), (None, "a", None), (1, "a", None), (1, "a", None), (2, "a ", None)]
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in radix.exact_duplicates(docs_of(spark, rows)).collect())
    assert got == [(0, None, 1, True), (0, None, 1, True), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]
    assert radix.exact_duplicates(docs_of(spark, [])).count() == 0


# near-dedup


def brute_near(rows):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopies.near_duplicates(docs).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text, None), (4, text, None), (4, text, None), (9, text.upper(), None), (7, None, None), (8, "", None), (10, "Word", None), (11, "wORD", None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in nearcopies.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(0, 3, None, True), (4, 3, 4, True), (4, 3, 4, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 4, False), (10, 1, 10, True), (11, 1, 10, False)]
    assert nearcopies.near_duplicates(docs_of(spark, [])).count() == 0


def test_links_off_the_first_centre_are_found(spark):
    """A base and variants that are similar to it, but not to each other: whichever is the centre, all become one component."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = [(100, " ".join(base), None)]
    for i in range(12):
        w = list(base)
        for at in rng.sample(range(0, 400, 20), 10):
            w[at] = f"v{i}"
        rows.append((i, " ".join(w), None))
    expected = brute_near(rows)
    assert len({c for _, c, _ in expected.values()}) < 4
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopies.near_duplicates(docs_of(spark, rows)).collect()} == expected


def test_pairs_in_a_large_family_under_the_threshold_are_found(spark):
    """1,000 members at 0.70 to each other; 40 pairs at 0.75 that mostly share the family's buckets alone."""
    template = [f"t{k}" for k in range(166)]
    tails = [[f"m{i}w{k}" for k in range(34)] for i in range(1000)]
    for i in range(0, 80, 2):
        tails[i + 1][:6] = tails[i][:6]
    rows = [(i, " ".join(template + tail), None) for i, tail in enumerate(tails)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: i - i % 2 if i < 80 else i for i in range(1000)}


def test_pairs_off_the_centre_without_any_other_link(spark):
    """Three members share buckets, and only the two that are no centre are similar."""
    centre = spark.range(3).orderBy(F.xxhash64(F.lit(0), F.col("id"))).first()[0]
    tails = [[f"m{i}w{j}" for j in range(34)] for i in range(3)]
    a, b = [i for i in range(3) if i != centre]
    tails[b][:8] = tails[a][:8]
    rows = [(i, " ".join([f"t{k}" for k in range(166)] + tail), None) for i, tail in enumerate(tails)]
    expected = brute_near(rows)
    assert len({c for _, c, _ in expected.values()}) == 2
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopies.near_duplicates(docs_of(spark, rows)).collect()} == expected


def test_prefix_pairs_hold_every_similar_pair(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(150)]
    sets += [sorted({*s, *rng.sample(range(1000), 3)} - set(rng.sample(s, len(s) // 12))) for s in sets]
    table = spark.createDataFrame([(i, i % 290, s) for i, s in enumerate(sets)], "id bigint, component bigint, items array<bigint>")
    for percent in (60, 75, 90):
        got = {(r.a, r.b) for r in nearcopies.prefix_pairs(table, percent).collect()}
        alike = {(a, b) for b in range(300) for a in range(b) if a % 290 != b % 290 and len({*sets[a]} & {*sets[b]}) * 100 >= len({*sets[a]} | {*sets[b]}) * percent}
        assert alike and alike <= got


def test_densified_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, common in ((40, 30), (2000, 1500)):
        items = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(items[:n]), np.unique(items[n - common:2 * n - common])
        near = np.mean(nearcopies.signature(a, 4096) == nearcopies.signature(b, 4096))
        assert abs(near - common / (2 * n - common)) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (12, 11), (11, 10), (10, 13), (13, 14), (14, 15), (3, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys(range(10, 16), 10)}


# substrings


def brute_substrings(texts, length=200):
    seen = collections.Counter(t[i:i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out[k] = (len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(docs, rows):
    expected = brute_substrings({i: (t or "").encode() for i, t, _ in rows})
    assert sum(v[1] for v in expected.values()) > 10000
    for group in (512, 0):  # 0: all anchors by ranges
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated_bytes(docs, group=group).collect()}
        assert got == expected


def test_repeated_bytes_odd_rows(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(250))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.repeated_bytes(docs_of(spark, [(5, text, None), (5, text, None), (6, text[:199], None), (None, text[40:], None), (None, None, None)])).collect())
    assert got == [(0, 0, 0, 0), (0, 210, 210, 1), (5, 250, 250, 1), (5, 250, 250, 1), (6, 199, 0, 0)]
    assert substrings.repeated_bytes(docs_of(spark, [])).count() == 0


def test_repeated_bytes_under_one_id(spark):
    draw = random.Random(3)
    a, b = ("".join(draw.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, a, None), (1, b, None), (1, b, None), (2, "x" + a[50:300], None), (None, None, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.repeated_bytes(docs_of(spark, rows)).collect())
    assert got == [(0, 0, 0), (1, 400, 250), (1, 400, 400), (1, 400, 400), (2, 251, 250)]


def test_long_texts_of_one_period(spark):
    rows = [(1, "é" * 40000, None), (2, "abc" * 20000, None), (3, "q" * 150 + "é" * 110, None)]
    for group in (512, 0):
        got = {r.doc_id: r.n_removed for r in substrings.repeated_bytes(docs_of(spark, rows), group=group).collect()}
        assert got == {1: 80000, 2: 60000, 3: 220}


def test_repeated_bytes_in_a_family(spark):
    """A template with changed words: by ranges as by plain comparison."""
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(draw.choice([0, 1, 2, 4])):
            own[draw.randrange(len(own))] = f"own{i % 40}"
        rows.append((i, " ".join(own[draw.randrange(20):]), None))
    expected = brute_substrings({i: t.encode() for i, t, _ in rows})
    for group in (512, 0):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated_bytes(docs_of(spark, rows), group=group).collect()}
        assert got == expected


# packing


def test_packing_holds_every_id_once(docs, rows):
    names = queries.tokenizer_files()
    encode = packing.encoder(*names)
    pieces = packing.pack(docs, *names, ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t, _ in rows:
        ids = [*encode(t or "").tolist(), 1]
        back = []
        for p in sorted(by_doc[i], key=lambda p: p.start):
            part = np.frombuffer(p.ids, "<u4")
            assert (p.start, p.length, p.doc_tokens, p.ids_crc32) == (len(back), len(part), len(ids), zlib.crc32(p.ids))
            back += part.tolist()
        assert back == ids
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_packing_odd_rows(spark):
    names = queries.tokenizer_files()
    got = packing.pack(docs_of(spark, [(None, None, None), (3, "", None), (3, "", None)]), *names).collect()
    assert [(r.length, r.doc_tokens) for r in got] == [(1, 1)] * 3
    assert packing.pack(docs_of(spark, []), *names).count() == 0


def test_ranks_give_the_ids_of_the_tokenizer_file(rows):
    import public_tokenizers

    plain, ranks = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), None), packing.encoder(*queries.tokenizer_files())
    for text in [t for _, t, _ in rows if t] + ["a <|endoftext|> b", "  \n\n\t x y", "don't 12345 '' 🙂 \x00"]:
        assert plain(text).tolist() == ranks(text).tolist()


def test_cuts_are_of_reciprocal_classes():
    for n in (1, 127, 128, 2047, 2048, 5000):
        lengths = packing.cuts(n)
        assert sum(lengths) == n and all(2048 % x == 0 for x in lengths[:-1])


# mixing


def test_mix_meets_targets(docs, rows):
    got = {r.doc_id: r for r in mixing.mix(docs, block=4, shard=500).collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert {i: r["size"] for i, r in got.items()} == sizes
    order = sorted({s for _, _, s in rows if s}) + [None]
    source = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in order}
    share, fixed = 1.5 * sum(source.values()), {}
    while True:  # reshare what is above, until nothing is
        free = {s: (3, 1, 2)[order.index(s) % 3] for s in order if s not in fixed}
        level = (share - sum(fixed.values())) / sum(free.values())
        above = {s: 2 * source[s] for s, w in free.items() if level * w > 2 * source[s]}
        if not above:
            break
        fixed |= above
    target = {s: fixed.get(s, level * free.get(s, 0)) for s in order}
    taken = collections.Counter()
    for i, _, s in rows:
        assert got[i].source_size == source[s] and abs(got[i].target - target[s]) < 1e-6
        assert got[i].taken <= 2 * sizes[i]
        taken[s] += got[i].taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), block=4, shard=500).collect()}


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 100, 1003):
        weights = [(k, float(rng.choice([0, 1, 2, 3.5, 10, 400]))) for k in range(15)]
        expected = collections.Counter()
        for _ in range(seats):
            k = max(weights, key=lambda x: (x[1] / (2 * expected[x[0]] + 1), -x[0]))[0]
            expected[k] += 1
        t = spark.createDataFrame(weights, "k int, w double")
        assert {r.k: r.quota for r in mixing.apportion(t, [], "k", "w", F.lit(seats)).collect()} == {k: expected[k] for k, _ in weights}


def test_mixed_texts_are_the_words_taken(docs, rows):
    out = mixing.mixed_texts(docs, block=4, shard=500)
    assert out.columns == docs.columns
    words = collections.Counter()
    texts = {i: t or "" for i, t, _ in rows}
    for r in out.collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in mixing.mix(docs, block=4, shard=500).collect() if r.taken}


def test_mix_odd_rows(spark):
    rows = [(None, "a b c", None), (None, None, None), (1, "a b c d", "x"), (1, "a b c d", "x")]
    got = mixing.mix(docs_of(spark, rows), block=1).collect()
    assert sorted(r["size"] for r in got) == [0, 3, 4, 4] and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(docs_of(spark, [])).count() == 0 and mixing.mixed_texts(docs_of(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(docs_of(spark, [(1, "", "a"), (2, None, "b")])).collect()} == {0}


# chat


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, segments int")


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "\\\\<|im_end|>\\", "<|im_start|>user<|im_sep|>", "</s>[INST] ok [/INST]", "<<|im_end|>", "[[INST]\\[INST]", "a\nb"]
    rows = [(1, i, r, t) for i, (t, r) in enumerate(zip(odd, ["system", *["user", "assistant"] * 4]))]
    rows += [(2, 0, "user", "hi"), (3, 0, "assistant", "x"), (3, 1, "user", "y"), (4, 0, None, "<|im_sep|>"), (None, 5, "user", "q"), (None, 5, "user", "q"), (5, None, "assistant", "b"), (5, 0, "user", "a")]
    out = chat.format_chats(turns_of(spark, rows)).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for conv, r in got.items():
        own = sorted([x for x in rows if x[0] == conv], key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_end|>") == len(own)
    assert {c: (r.valid, r.first_bad) for c, r in got.items()} == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, 0), None: (False, 1), 5: (False, 0)}
    assert chat.format_chats(turns_of(spark, [])).count() == 0


def test_chat_rejects_ambiguous_marks(spark):
    with pytest.raises(ValueError):
        chat.format_chats(turns_of(spark, []), chat.Template(open="||"))


# search


def brute_top(vectors, k=5, every=1):
    ok = {i: np.floor(np.array(v, float) * 256) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in ok.items() if i != q and len(y) == len(x))[:k]
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).round(2).tolist()) for i in range(60)] + [(100 + i, [0.5] * 6) for i in range(30)]
    vectors += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (204, [1.0, 2.0]), (205, []), (206, []), (207, [0.0] * 6)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id bigint, embedding array<double>, dim int, block string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in threshold.top_k(df, df, block=block, query_block=5).collect()}
    assert got == brute_top(vectors)
    few = threshold.top_k(df, df, block=block, query_block=5, held=2)  # most of what is carried is written out early
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in few.collect()} == got
    assert threshold.top_k(df.limit(0), df).count() == 0 and threshold.top_k(df, df.limit(0)).count() == 0


def test_threshold_stops_early():
    """One vector is far ahead: the lists are not read to their end."""
    x = np.ones((4096, 8))
    x[17] = 1000
    lists = np.argsort(-x, axis=0, kind="stable")
    read = []
    plain, threshold.exact_scores = threshold.exact_scores, lambda a, q: read.append(len(a)) or plain(a, q)
    try:
        ids, scores = threshold.threshold_top(np.ones(8), x, np.arange(4096), lists, np.take_along_axis(x, lists, 0), 1, -1)
    finally:
        threshold.exact_scores = plain
    assert ids.tolist() == [17] and scores.tolist() == [8000] and sum(read) < 100


def test_carried_threshold_spares_blocks():
    """A block whose heads are below the carried kth score is left unread; one with a tie of smaller id is not."""
    read, lists = [], np.argsort(-np.ones((512, 4)), axis=0, kind="stable")
    plain, threshold.exact_scores = threshold.exact_scores, lambda a, q: read.append(len(a)) or plain(a, q)
    try:
        x = np.ones((512, 4))
        look = lambda score: threshold.threshold_top(np.ones(4), x, np.arange(512), lists, x, 2, -1, np.array([900, 901]), np.array([9, score]))
        ids, scores = look(5)
        assert (ids.tolist(), scores.tolist(), read) == ([900, 901], [9, 5], [])
        ids, scores = look(4)
        assert (ids.tolist(), scores.tolist()) == ([900, 0], [9, 4]) and sum(read) == 512
    finally:
        threshold.exact_scores = plain


def test_carried_threshold_equals_one_block():
    """Random blocks read one after the other give what all rows in one block give."""
    rng = np.random.default_rng(4)
    x, ids = np.floor(rng.normal(size=(600, 5)) * 8), rng.permutation(600)
    for q in np.floor(rng.normal(size=(20, 5)) * 8):
        carried, own = (None, None), int(ids[0])
        for at in range(0, 600, 150):
            order = np.argsort(ids[at:at + 150])
            part, keys = x[at:at + 150][order], ids[at:at + 150][order]
            lists = np.argsort(-part, axis=0, kind="stable")
            carried = threshold.threshold_top(q, part, keys, lists, np.take_along_axis(part, lists, 0), 5, own, *carried)
        total = (x @ q).astype(int)
        best = sorted((-s, i) for s, i in zip(total, ids) if i != own)[:5]
        assert list(zip(carried[1].tolist(), carried[0].tolist())) == [(-s, i) for s, i in best]


# WARC


def test_archive_round_trip(spark):
    long = "<p>" + "wörter " * 400 + "</p>"
    pages = [(1, "http://a.example/é \r\nX: y", long), (5, "http://b.example", long), (3, None, long), (4, "u", "short"), (6, "u", "short"), (7, "v", None), (None, "w", long), (8, "z", ""), (9, "q", "\r\n\r\n" * 500)]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id bigint, url string, html string, size int, digest string")
    folder = new_path(spark, "warc-test")
    assert warc.write_archives(df, folder) == len(pages)
    got = {r.page_id: r for r in warc.read_archives(spark, folder, payload=True).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        r = got[i]
        revisit = html == long and i != 5
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
        assert r.payload == (None if revisit else raw)
    assert "\n" not in got[1].url


def test_archive_frames_stand_alone():
    records = [warc.record(i, "u", f"body {i}".encode() * 50, 350, "00" * 20, None) for i in range(300)]
    dictionary = warc.train(records)
    import zstandard

    shrink = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = warc.struct.pack("<II", warc.MAGIC, len(dictionary)) + dictionary + b"".join(map(shrink.compress, records))
    assert list(warc.frames(data)) == records
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    assert list(warc.frames(b"")) == [] and warc.train([]) == b""


def test_archives_roll_over(spark):
    """Every archive starts with the dictionary and ends at the limit; a second run with fewer archives leaves none of the first."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(200)], "page_id bigint, url string, html string")
    folder, counts = new_path(spark, "warc-test"), []
    for limit in (4096, 1 << 27):
        assert warc.write_archives(pages, folder, archive=limit) == 200
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content").collect()
        counts.append(len(found))
        magic = [warc.struct.unpack_from("<I", r.content)[0] == warc.MAGIC for r in found]
        assert all(magic)
        got = warc.read_archives(spark, folder, payload=True).collect()
        assert sorted((r.page_id, r.payload.decode()) for r in got) == sorted((r.page_id, r.html) for r in pages.collect())
    assert counts[0] > counts[1]


def test_archive_of_no_pages(spark):
    folder = new_path(spark, "warc-test")
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_archives(empty, folder) == 0
    assert warc.read_archives(spark, folder).count() == 0


# toxicity


def test_noisy_or_learns_which_sentence(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(80)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(5)]
        if toxic := i % 5 == 0:
            sentences[rng.randrange(5)] += " " + rng.choice(["vilexa", "vilexo", "nastyword"])
        rows.append((i, ". ".join(sentences) + ".", None))
        labels.append((i, 1, int(toxic)))
    docs = docs_of(spark, [*rows, (1000, None, None), (1001, "", None), (None, "one vilexing word", None)])
    known = spark.createDataFrame([*labels, (None, 0, 1), (3000, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, known.filter(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i in held)
    for i in held:
        for s in got[i].sentences:
            assert re.search("vilex|nasty", rows[i][1][s["from"]:s["to"]])
    assert got[1000].score == got[1001].score < 0.3 and got[None].score >= 0.3
    assert toxicity.train(docs, known.limit(0)).weights == {} and toxicity.score(docs.limit(0), model).count() == 0


def plain_noisy_or(text, weights, bias):
    """Sentences found character by character, probabilities multiplied one by one."""
    sentences, ended = [""], False
    for c in text or "":
        if c in ".!?\n":
            ended = True
        else:
            if ended:
                sentences.append("")
            sentences[-1] += c
            ended = False
    clean, any_sentence = 1.0, False
    for sentence in sentences:
        if sentence:
            z = bias
            for word in re.findall(r"\w+", sentence.lower()):
                z += weights.get(word, 0.0) + sum(weights.get("^" + word[:n], 0.0) for n in toxicity.STEMS if len(word) > n)
            clean, any_sentence = clean / (1 + math.exp(z)), True
    return 1 - clean if any_sentence else 1 - 1 / (1 + math.exp(bias))


def test_scores_are_the_plain_noisy_or(spark):
    rng = random.Random(8)
    weights, bias = {"bad": 4.0, "^bad": 2.5, "worse": 6.0, "kind": -3.0, "^gras": 1.0}, -5.0
    pieces = ["bad", "Badly", "worse", "kind", "grass", "tree", ".", "!", "\n", "?!", " ", "é", ""]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(40))), None) for i in range(300)]
    rows += [(300, None, None), (301, "...", None), (302, "bad " * 200_000, None), (303, "tree. " * 100_000 + "worse worse", None), rows[0]]
    got = toxicity.score(docs_of(spark, rows), toxicity.Model(weights, bias)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id != 302:  # exp would overflow in the plain way
            assert r.score == pytest.approx(plain_noisy_or(texts[r.doc_id], weights, bias), abs=1e-9), r.doc_id
        else:
            assert r.score == 1.0


# language


def test_evidence_fusion(spark):
    rng = random.Random(7)
    parts = {"aa": ["ba", "ko", "ti", "ra"], "bb": ["sch", "ung", "ei", "str"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, 60), lang, f"h{i % 3}.{lang}.example") for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    odd = [(900, "", None, "h0.aa.example"), (901, None, None, "h1.bb.example"), (902, None, None, None), (903, "⁂※ " * 80, None, None), (904, make("bb", 50), None, "h0.aa.example"), (905, make("bb", 50), None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id bigint, text string, lang string, host string, ll int, row string")
    model = language.train(df)
    out = language.identify(df, model, F.col("text"), host=F.col("host"))
    assert out.columns == [*df.columns, "language", "posterior", "text_language", "kept"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].language == lang and got[i].kept for i, _, lang, _ in rows)
    assert got[900].language == "aa" and got[901].language == "bb"  # the host decides
    assert not got[903].kept and got[904].language == got[905].language == "bb"
    assert language.identify(df.limit(0), model, F.col("text")).count() == 0
    nothing = language.identify(df.limit(5), language.train(df.filter("lang = 'zz'")), F.col("text"), host=F.col("host")).collect()
    assert {(r.language, r.kept) for r in nothing} == {("und", False)}


def test_every_label_has_a_model(spark, monkeypatch):
    """70 labels, and a rare one (of one text) beside 5,000 rows of another; too many labels are an error, not left out."""
    of = lambda k: " ".join(chr(97 + k // 26) + chr(97 + k % 26) + c for c in "abcdefgh")
    many = spark.createDataFrame([(of(k) * (1 + (k < 64)), f"l{k}") for k in range(70)], "text string, lang string")
    assert set(language.train(many).languages) == {f"l{k}" for k in range(70)} | {"und"}
    rare = [(f"{of(0)} {i}", "big") for i in range(5000)] + [("zzyx wvut", "rare")] * 2
    df = spark.createDataFrame(rare, "text string, lang string")
    assert set(language.train(df, sample=50).languages) == {"big", "rare", "und"}
    one = spark.createDataFrame([("zzyx wvut", "one")] * 500 + rare, "text string, lang string")
    assert set(language.train(one, sample=1).languages) == {"big", "one", "rare", "und"}
    monkeypatch.setattr(language, "MOST_LANGUAGES", 69)
    with pytest.raises(ValueError):
        language.train(many)


def test_parts_of_pages(spark):
    page = '<!DOCTYPE html><HTML class="x" lang="de-AT"><script>var t="</p>";</script><!-- <b> --><p>Gr&uuml;n &amp; <b>gut</b></p></html>'
    df = spark.createDataFrame([(page, "https://me@M.Site.de:80/x?y"), (None, None), ("plain", "nothing")], "h string, u string")
    got = df.select(language.declared_in(F.col("h")).alias("d"), language.visible_text(F.col("h")).alias("v"), language.host_of(F.col("u")).alias("host")).collect()
    assert [(r.d, r.host) for r in got] == [("de", "m.site.de"), (None, None), (None, None)]
    assert got[0].v.split() == ["Gr", "n", "gut"] and got[2].v == "plain"
