"""Fill-in-middle, weak supervision and conversation repair against plain definitions, and their defined results for odd input."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest

from strideframe.llm import infill, quality, queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, form string, n bigint, output string, posterior double, words int, `count` int, kept string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, "y", 0.5, 1, 2, "z") for i, t in rows], DOCS)


def texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeghé#") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    out = [rng.choice(["\n", ""]) + "".join(rng.choice(words) + rng.choice([" ", "\n", ".\n", "\n\n", "\r\n"]) for _ in range(rng.choice([1, 4, 9, 30, 200]))) for _ in range(60)]
    out += ["", None, "\n", "\n\n", "no feed", "a <P> b\nc", "<S>", "x<M", "<\n<\nS>\n", "P>\n<", "äöü\n€\n𝄞 clef\n", " \t\n \n", "same same same same same same same same\n" * 4, out[3], out[3]]
    return [(i * 7 - 30, t) for i, t in enumerate(out)] + [(None, "no id\nat all\n"), (5, "a repeated id\n"), (5, "a repeated id\n")]


# fill in the middle


def brute_infill(id, text, seed=7, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or h3 % 100 >= percent or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("options", [{}, {"seed": 11, "fim_percent": 60, "spm_percent": 20}])
def test_infill_and_back(spark, options):
    rows = texts() + [(999, "line of a very long text, é\n" * 200_000)]
    got = infill.transform(docs_of(spark, rows).repartition(4), **options)
    plain = {"seed": options.get("seed", 7), "percent": options.get("fim_percent", 100), "spm": options.get("spm_percent", 50)}
    exp = collections.Counter((i, *brute_infill(i, t, **plain)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()) == exp
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got.collect())
    back = infill.restored(got, carry=("n", "form")).collect()
    assert collections.Counter((r.doc_id, r.restored) for r in back) == collections.Counter((i, t or "") for i, t in rows)
    assert all(r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest() for r in back)


def test_infill_of_nothing(spark):
    empty = infill.transform(docs_of(spark, [(1, "a")]).filter("doc_id = 2"))
    assert empty.count() == 0 and infill.restored(empty).count() == 0


def test_piece_table_cuts_and_arranges():
    rng = random.Random(2)
    text = "".join(rng.choice("ab\n") for _ in range(50)).encode()
    view = memoryview(text)
    table = infill.Pieces.joined(view, infill.Pieces(view).cut(7, 7, 30))  # three descriptors
    for _ in range(50):
        places = sorted(rng.randint(0, 50) for _ in range(3))
        parts = table.cut(*places)
        assert [b"".join(p.stream()) for p in parts] == [text[a:b] for a, b in zip([0, *places], [*places, 50])]
    for form in infill.FORMS:
        arranged = infill.arrange(view, infill.Pieces(view).cut(4, 9), form)
        output = b"".join(arranged.stream())
        assert arranged.digest() == hashlib.sha256(output).hexdigest()
        assert b"".join(infill.restore(memoryview(output), form).stream()) == text


# quality


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct": len(set(words)), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_small": sum("a" <= c <= "z" for c in text),
            "n_shouts": text.count("!!"), "n_plain_ends": sum(w[-1] > "\x7f" or w[-1].isalnum() or w[-1] in ".,;:!?\"')" for w in words),
            "n_spoken": sum(any(c > "\x7f" or c.isalpha() for c in w) for w in words), "n_doubled": sum(a == b for a, b in zip(words, words[1:]))}


def test_counts_of_texts(spark):
    rows = texts() + [(998, "Shout!! LOUD!!! ok\x1c\x85\xa0 | | $$ 12, (x) \"q\""), (999, " ".join(f"w{i % 7000}" for i in range(60_000)))]
    got = collections.Counter(tuple(r) for r in quality.counts(docs_of(spark, rows).repartition(4)).collect())
    assert got == collections.Counter((i, *(brute_counts(t)[c] for c in quality.COUNTS)) for i, t in rows)


def plain_maximisation(patterns, rounds):
    """The same model one document and one rule at a time."""
    k, total = len(patterns[0]), len(patterns)
    good, a, b = quality.START, [quality.RIGHT_GOOD] * k, [quality.RIGHT_BAD] * k

    def posterior(v):
        up = math.prod(1 if x == 0 else a[j] if x == 1 else 1 - a[j] for j, x in enumerate(v)) * good
        down = math.prod(1 if x == 0 else 1 - b[j] if x == 1 else b[j] for j, x in enumerate(v)) * (1 - good)
        return up / (up + down)

    for _ in range(rounds):
        p = [posterior(v) for v in patterns]
        good = (sum(p) + quality.START) / (total + 1)
        seen = quality.WEIGHT_GOOD * total, quality.WEIGHT_BAD * total
        a, b = ([(sum(x for x, v in zip(p, patterns) if v[j] == 1) + quality.RIGHT_GOOD * seen[0]) / (sum(x for x, v in zip(p, patterns) if v[j]) + seen[0]) for j in range(k)],
                [(sum(1 - x for x, v in zip(p, patterns) if v[j] == -1) + quality.RIGHT_BAD * seen[1]) / (sum(1 - x for x, v in zip(p, patterns) if v[j]) + seen[1]) for j in range(k)])
    return [posterior(v) for v in patterns]


def test_judgement_against_plain_maximisation(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "reading", "stone", "later", "evening", "under", "with", "glass", "quiet", "harbour", "seven", "autumn"]) + rng.choice(["", "", "", ".", ","])
                     for _ in range(60)) for _ in range(80)]
    bad = [" ".join(w + "###" for w in good[i].split()) for i in range(8)] + [good[i].upper().replace(" ", "!! ") for i in range(8, 14)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + texts()
    got = quality.judge(docs_of(spark, rows).repartition(3)).collect()
    names = [r.name for r in quality.RULES]
    exp = plain_maximisation([[r[n] for n in names] for r in got], quality.ROUNDS)
    for r, p in zip(got, exp):
        assert abs(r.posterior - p) < 1e-9
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.posterior >= 0.5)
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None and 0 <= r.doc_id < 94 and r.n_words == 60}
    assert all(kept[i] for i in range(80) if i in kept) and not any(kept[i] for i in range(80, 94) if i in kept)


def test_votes_of_rules(spark):
    row = {c: 0 for c in quality.COUNTS} | {"n_words": 40, "word_chars": 200, "n_symbols": 4, "n_plain_ends": 40, "n_spoken": 33, "n_distinct": 20}
    table = spark.createDataFrame([tuple(row[c] for c in quality.COUNTS), (0,) * len(quality.COUNTS)], ", ".join(f"{c} bigint" for c in quality.COUNTS))
    one, nothing = (r.asDict() for r in table.select(*(r.vote() for r in quality.RULES)).collect())
    assert one == {"words": 0, "word_length": 1, "symbols": -1, "word_ends": 1, "spoken_words": 0, "repeated_lines": 0, "repeated_words": 1, "doubled_words": 1,
                   "capitals": 0, "shouts": 1, "variety": 0}
    assert set(nothing.values()) == {0}


def test_quality_of_nothing(spark):
    assert quality.judge(docs_of(spark, [(1, "a")]).filter("doc_id = 2")).count() == 0
    assert quality.estimate(np.zeros((0, 3), int), np.zeros(0)).good == quality.START


# conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return out


def brute_repair(rows):
    """Least (cost, edits) by Dijkstra's algorithm over (row, last role); returns a summary row without the id."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "us", "s": "u", "u": "a", "a": "u"}
    asked = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, turns = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        full = {"u": "user", "a": "assistant"}[asked[last]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, asked[last], turns + (f"{full}:",)))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, turns))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], turns + (f"{role}:{text}",)))
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, asked[last], turns + (f"{full}:{text}",)))
    numbers = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def chats():
    rng = random.Random(8)
    lines = ["Fine.", "And then", "What?", "", " ", None, "Yes!\n", "no end", "x" * 50 + ".", "Ω…", "a.\t"]
    rows = []
    for conv in [*range(70), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 21])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", None, "", "s", "Assistant"]) if rng.random() < 0.15 or turn == 0 and rng.random() < 0.3 else role
            rows.append((conv, None if rng.random() < 0.1 else turn + 3 * (rng.random() < 0.1), role, rng.choice(lines) if rng.random() < 0.6 else f"Line {rng.random()}."))
    rows += [rows[5]] * 2 + [(500, None, None, None), (501, 1, "user", "Long " * 200_000 + "end.")]
    return rows


CHATS = "conv_id bigint, turn bigint, role string, text string, part int, at string, first boolean, state int, `rows` int, absent boolean"


def expected(rows, damaged):
    groups = {r[0]: [] for r in rows}
    for r in damaged:
        groups[r[0]].append(r)
    return {conv: brute_repair(group) for conv, group in groups.items()}


@pytest.mark.parametrize("chunk_bits", [12, 2, 0])
def test_repair_of_damaged_chats(spark, chunk_bits):
    """Parts of 4,096, four and one row: conversations of many parts are mended as those of one."""
    rows = chats()
    table = spark.createDataFrame([(*r, 1, "a", True, 2, 3, True) for r in rows], CHATS).repartition(5)
    repaired = repair.repair(repair.damage(table), chunk_bits)
    got = {r[0]: tuple(r[1:]) for r in repair.summaries(repaired).collect()}
    assert got == expected(rows, brute_damage(rows))
    if chunk_bits == 0:
        assert repaired.groupBy("conv_id").count().filter("count > 15").count() > 3


def test_repair_gives_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (2, 0, "system", "Be kind.")]
    table = spark.createDataFrame([(*r, False) for r in rows], "conv_id bigint, turn int, role string, text string, absent boolean")
    got = {r.conv_id: (r.audit, r.cost, [tuple(t) for t in r.turns]) for r in repair.repair(table).collect()}
    assert got == {1: ("IKKDI", 10, [("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")]), 2: ("D", 4, [])}


def test_one_hot_conversation_and_text_keys(spark):
    """A conversation of 2,500 rows in parts of 64, with a text id."""
    rng = random.Random(1)
    rows = [("hot", i, ["user", "assistant"][(i + rng.randrange(12) // 11) % 2], f"Row {i}." if rng.random() < 0.8 else "ok") for i in range(2_500)] + [("b", 1, "user", "Hm.")]
    table = spark.createDataFrame([(*r, False) for r in rows], "conv_id string, turn int, role string, text string, absent boolean").repartition(7)
    got = {r[0]: tuple(r[1:]) for r in repair.summaries(repair.repair(table, 6)).collect()}
    assert got["b"] == brute_repair(rows[-1:])
    exp = dynamic_programme(rows[:-1])
    assert (got["hot"][5], got["hot"][6]) == exp


def dynamic_programme(rows):
    """Least (cost, edits) from each state, last row first; a second plain definition for long conversations."""
    seen, codes = set(), []
    for _, _, role, text in rows:
        codes.append((role[:1], not text.strip() or (role, text) in seen, 3 * (text[-1:] not in ".!?")))
        seen.add((role, text))
    asked, after = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "us", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(2):
            best = {q: min(best[q], (best[asked[q]][0] + 3, "I" + best[asked[q]][1])) for q in best}
        return best

    best = inserted({q: (0, "") if q in ("", "a") else (1 << 40, "") for q in asked})
    for role, gone, late in reversed(codes):
        new = {}
        for q in asked:
            ways = [(4, "D", q)]
            if not gone:
                ways += [(late, "K", role)] * (role in after[q]) + [(3 + late, "R", asked[q])]
            new[q] = min((cost + best[to][0], letter + best[to][1]) for cost, letter, to in ways)
        best = inserted(new)
    return best[""]


def test_auction_prices_are_remaining_costs():
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.choice(["s", "u", "a", "?", "#", "u!", "a!", "s!"]) for _ in range(rng.randrange(9))]
        layers = repair.prices([*codes, ""], repair.END_PRICES)
        for i in range(len(codes) + 1):
            for state in range(4):
                heap, done = [(0, i, state)], set()
                while True:
                    cost, at, q = heapq.heappop(heap)
                    if at > len(codes):
                        break
                    if (at, q) not in done:
                        done.add((at, q))
                        for _, c, used, to in repair.arcs([*codes, ""][at])[q]:
                            heapq.heappush(heap, (cost + c, at + used, to))
                assert layers[i][state] == cost
        for state in range(4):  # costs between the ends of a part, composed with what follows
            cut = rng.randint(0, len(codes))
            between = repair.between(codes[:cut])
            assert layers[0][state] == min(between[state][to] + layers[cut][to] for to in range(4))


def test_repair_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.summaries(repair.repair(repair.damage(table))).count() == 0


def test_queries_are_registered():
    for name in ("op11_infill", "op12_quality_rules", "op13_conversation_repair"):
        assert name in queries.QUERIES and name in queries.ORACLES
