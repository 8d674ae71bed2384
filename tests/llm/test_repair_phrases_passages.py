"""The three operators on conversations, phrases and passages beside plain computations of the same results."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import collocations, conversations, fmindex
from vigil.llm.common import texts

DOCS = "doc_id long, text string, lang string, source string, n_chars int, h string, k string, crc string"


def prose(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---- op11


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_passages(rows, window):
    least = {}
    for doc, text, *_ in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    passage, common = prose(rng, 70), prose(rng, 30)
    out = [prose(rng, rng.choice([0, 1, 49, 50, 51, 90, 200])) for _ in range(40)]
    out += [f"{prose(rng, 25)} {passage} {prose(rng, 25)}" for _ in range(12)]
    out += [f"{prose(rng, 30)}  {common}\n\t{prose(rng, 40)}" for _ in range(30)]  # a common phrase shorter than a window
    base = prose(rng, 160).split()
    for k in range(8):
        base[(31 * k) % 160] = f"x{k}"
        out.append(" ".join(base))
    out += [None, "", " \n\t ", "a " * 300, "a " * 120, "é ü " * 80, out[5], out[5], out[45], prose(rng, 20_000)]
    out += [out[-1][: len(out[-1]) // 2], "A " + out[45], out[45].upper()]
    rows = [(100 - i if i % 2 else 300 + i, t, "en", None, 0, "clash", "clash", "clash") for i, t in enumerate(out)]
    return [*rows, rows[44], (None, out[45], *[None] * 6), (None, out[45], *[None] * 6), (rows[44][0], out[50], *[None] * 6)]


@pytest.mark.parametrize(("window", "digit", "crowd", "shard"), [(50, 20, 4096, 1 << 19), (50, 20, 3, 200), (12, 5, 8, 1000), (50, 50, 4096, 1 << 19)])
def test_passages_go(spark, passages, window, digit, crowd, shard):
    docs = spark.createDataFrame(passages, DOCS).repartition(5)
    found = fmindex.repeated_windows(texts(docs), window, digit, crowd, shard).collect()
    got = []
    for row in found:
        words = fmindex.Words(fmindex.zstandard.ZstdDecompressor().decompress(bytes(row.packed)))
        got.append((None if row.doc_id == fmindex.NO_ID else row.doc_id, fmindex._said(words, fmindex.kept_words(words.n, row.places, row.sizes, window)).decode()))
    assert sorted(got, key=str) == plain_passages(passages, window)


def test_passages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fmindex.without_passages(empty).collect() == []


def test_without_passages(spark, passages):
    got = fmindex.without_passages(spark.createDataFrame(passages, DOCS).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_passages(passages, 50)


def test_matching_statistics():
    rng = np.random.default_rng(3)
    indexed = [rng.integers(1, 4, n) for n in (0, 1, 30, 80, 80, 200)]
    owners = np.array([4, 0, 3, 1, 1, 2])
    streamed = [indexed[3].copy(), rng.integers(0, 5, 150), indexed[5][40:90], np.zeros(0, np.int64), np.ones(20, np.int64)]
    by = np.array([1, 9, 3, 9, 2])
    index = fmindex.FMIndex(indexed, owners)

    def longest(text, i, own, most):
        for n in range(min(most, len(text) - i), 0, -1):
            if any(o < own and any((x[j : j + n] == text[i : i + n]).all() for j in range(len(x) - n + 1)) for x, o in zip(indexed, owners, strict=True)):
                return n
        return 0

    for most in (5, 12, 1000):
        found = index.matching_statistics([np.where(x < 4, x, 0) for x in streamed], by, most)
        assert [x.tolist() for x in found] == [[longest(np.where(x < 4, x, 0), i, o, most) for i in range(len(x))] for x, o in zip(streamed, by, strict=True)]


def test_rank():
    rng = np.random.default_rng(4)
    for sigma, n in ((1, 5), (2, 64), (9, 500), (300, 1000)):
        s = rng.integers(0, sigma, n)
        matrix = fmindex.WaveletMatrix(s, sigma)
        c, i = rng.integers(0, sigma, 200), rng.integers(0, n + 1, 200)
        assert matrix.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i, strict=True)]


# ---- op12


def plain_repair(turns):
    """All edits of a short conversation, one row after the other: the least (cost, audit) that ends in each role sequence's state."""
    faults, seen = [], set()
    for role, text in turns:
        own = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "t"
        seen.add((role, text))
        faults.append(own)
    best = None
    options = []
    for (role, text), own in zip(turns, faults, strict=True):
        more = 5 if own == "t" else 0
        options.append([("D", 2, None)] + ([] if own in ("b", "d") else [("K", more, (role, text))] + [("R", 1 + more, (r, text)) for r in ("user", "assistant")]))
    inserts = [[]] + [[x] for x in ("user", "assistant")] + [["user", "assistant"], ["assistant", "user"]]
    for chosen in itertools.product(*options):
        for slots in itertools.product(inserts, repeat=len(turns) + 1):
            out, audit, cost = [], "", 0
            for k, slot in enumerate(slots):
                out += [(r, "") for r in slot]
                audit += "I" * len(slot)
                cost += 5 * len(slot)
                if k < len(chosen):
                    letter, price, kept = chosen[k]
                    audit, cost = audit + letter, cost + price
                    out += [kept] if kept else []
            if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return faults, best


def test_cheapest_repair_against_all_edits():
    rng = random.Random(12)
    for n in (0, 1, 2, 3):
        for _ in range(12 if n < 3 else 6):
            turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", " ", "c!", "c! "])) for _ in range(n)]
            faults, (cost, audit, text) = plain_repair(turns)
            cells = conversations.chart([conversations.leaf(r[:1], f in ("b", "d"), f == "t") for (r, _), f in zip(turns, faults, strict=True)])
            assert conversations.cheapest(cells) == (cost, audit), turns
            assert "\n".join(f"{r}:{t}" for r, t in conversations.edited(iter(turns), audit)) == text


def plain_report(rows):
    """The contract, row by row; the repair by the least (cost, audit) of each state, one edit after the other."""
    damaged = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        damaged[conv] += []
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in damaged.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        known, seen, faults = [t for t, *_ in turns if t is not None], set(), []
        for _, role, text in turns:
            faults.append("b" if not text.strip(" \t\n\v\f\r") else "d" if (role, text) in seen else "" if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "t")
            seen.add((role, text))
        states = {"": (0, "")}  # a role sequence is known by its last initial
        steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        def insert(states):
            for _ in range(3):
                for (p, r), q in steps.items():
                    if r != "s" and p in states:
                        new = (states[p][0] + 5, states[p][1] + "I")
                        states[q] = min(states.get(q, new), new)
            return states

        for (_, role, _), own in zip(turns, faults, strict=True):
            after = {}
            for p, (cost, audit) in insert(states).items():
                moves = [(p, 2, "D")]
                if own in ("", "t"):
                    more = 5 * (own == "t")
                    moves += [(steps[p, r], more, "K") for r in "sua" if r == role[:1] and (p, r) in steps]
                    moves += [(steps[p, r], 1 + more, "R") for r in "ua" if (p, r) in steps]
                for q, price, letter in moves:
                    new = (cost + price, audit + letter)
                    after[q] = min(after.get(q, new), new)
            states = after
        cost, audit = min(v for k, v in insert(states).items() if k in ("", "a"))
        left = "\n".join(f"{r}:{t}" for r, t in conversations.edited(((r, t) for _, r, t in turns), audit))
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, n string, digest string, first string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(13)
    out = []
    for conv in range(60):
        turns = rng.choice([1, 2, 3, 6, 9])
        for turn in range(turns):
            role = "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[turn % 2] if rng.random() < 0.8 else rng.choice(["tool", "", None, "user", "été"])
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice([f"t{turn}.", "same.", "open", "", None, " \t", "done! \n", "é?"])))
    out += [(None, t, "user", "Hello.") for t in (0, 0, 1, None)] + [(77, None, None, None)]
    out += [(500, t, ("user", "assistant")[t % 2], f"turn {t // 3}.") for t in range(700)]  # one that spreads over the tasks
    out += [(501, 4, "user", "again.")] * 40
    out += [(600 + k, k, "user", "gone.") for k in range(40)]
    return [(*x, "clash", "clash", "clash") for x in out]


@pytest.mark.parametrize("tasks", [1, 8])
def test_report(spark, talks, tasks):
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = conversations.repair_report(spark.createDataFrame(talks, CONVERSATIONS).repartition(4))
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_report(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_report_of_an_empty_table(spark):
    assert conversations.repair_report(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "x.")]
    got = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "user", "b."), (1, 1, "assistant", "c.")]


# ---- op13


def plain_collocations(rows, least, share):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        if any(x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= share * a for (x, v), b in candidates.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(14)
    words = ["the", "The", "of", "new", "York", "état", "a b", "x\x0by", "'s", "--", "\x00", "日本"] + [f"v{i}" for i in range(20)]
    line = "new york city council, of the état"
    out = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!"]) for _ in range(rng.choice([0, 1, 2, 40, 120])))
        out.append((i, text + line * (i % 3), rng.choice(["en", "de", None, "und", "É"])))
    out += [(900, None, "en"), (901, "", "en"), (902, "la la la la " * 500, "en"), (903, "word", "fr"), (904, "." * 50, "fr"), (905, "tail ", "fr"), (905, "tail ", "fr")]
    out += [(1000 + i, out[3][1], "en") for i in range(30)]
    return [(*x, "clash", 0, "clash", "clash", "clash") for x in out]


@pytest.mark.parametrize(("least", "every"), [(10, 32), (2, 1), (4, 5)])
def test_collocations(spark, speech, least, every, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 1 << 14)
    docs = spark.createDataFrame(speech, DOCS).repartition(6)
    got = collocations.collocations(docs, least=least, every=every).select("lang", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_collocations(speech, least, 50)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_a_passage_has_the_same_chunks_wherever_it_stands():
    rng = random.Random(15)
    passage = prose(rng, 600)
    own = {c for _, c, _ in collocations.parse([passage.encode()])}
    moved = {c for _, c, _ in collocations.parse([f"{prose(rng, 37)} {passage} {prose(rng, 11)}".encode()])}
    assert len(own & moved) >= len(own) - 2 > 5


def test_scores_beyond_64_bits(spark):
    a, b = 3_000_000_000, 4_000_000_000
    rows = [("en", "x", 1, a), ("en", "y", 1, b), ("en", "x y", 2, a - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, a long")).collect()
    assert [(r.phrase, r.score) for r in got] == [("x y", 10**6 * (a - 1) ** 2 // (a * b))]


def test_counts_in_equal_hashes():
    h = np.array([5, 5, 5, 7, 5], dtype=np.uint64)
    g = np.array([1, 2, 1, 1, 2], dtype=np.uint32)
    got = collocations.added(h, g, np.array([1, 10, 100, 1000, 10_000]), np.array([4, 3, 2, 1, 0]))
    assert [x.tolist() for x in got] == [[5, 5, 7], [1, 2, 1], [101, 10_010, 1000], [2, 0, 1]]
    for x in (np.array([0, 1, 2**63], dtype=np.uint64), np.zeros(0, np.uint64), np.zeros(3, np.uint64)):
        assert collocations._plain(collocations._press(x)).tolist() == x.tolist()
