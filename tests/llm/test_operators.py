"""Each operator beside a plain computation of the same result, with the rows that are easy to get wrong."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vigil.llm import decontaminate, jaccard, pack, radix, resample, reshard, templates, topk, toxicity, warc
from vigil.llm.common import kth_largest, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, __id string, size string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [prose(rng, rng.choice([1, 3, 4, 5, 6, 40, 90, 200])) for _ in range(60)]
    base = prose(rng, 120)
    for k in range(12):  # near copies with more and more edits, a chain
        words = base.split()
        for j in range(k):
            words[(7 * j) % len(words)] = f"x{j}"
        out.append(" ".join(words))
    passage = prose(rng, 60)
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(8)]
    out += ["", None, " \n\t ", "AB cd EF gh ij", "ab CD ef GH ij", "é" * 300, "é" * 300 + "ü", "abc " * 200, "a" * 1200, out[3], out[3], prose(rng, 30_000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(out)]
    return rows + [rows[5], rows[-4], (None, out[2], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    words = (text or "").encode().lower().split() if (text or "").isascii() else bytes((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))).split()
    return set() if not words else {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and 100 * len(a & b) >= 75 * len(a | b):
                up[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return Counter((i, len(s), least.get(top(x))) for x, (i, s) in enumerate(sets))


def test_jaccard_join_finds_every_link(docs, rows):
    got = jaccard.similarity_classes(texts(docs)).collect()
    want = linked_components([(r[0], r[1]) for r in rows])
    assert Counter((None if r.doc_id < 0 else r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_regions_of_many_parts_and_rounds(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(jaccard, "TOGETHER", 2)
    got = jaccard.similarity_classes(texts(docs)).collect()
    assert Counter((None if r.doc_id < 0 else r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_components([(r[0], r[1]) for r in rows])


def test_jaccard_counters_stay_in_the_tasks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 2)
    came, kind = [], type(docs)

    def counted(rows_of):
        def call(self, *args, **more):
            out = list(rows_of(self, *args, **more))
            came.extend(len(x) for r in out for x in r if isinstance(x, bytes | bytearray))
            return out

        return call

    monkeypatch.setattr(kind, "toLocalIterator", counted(kind.toLocalIterator))
    monkeypatch.setattr(kind, "collect", counted(kind.collect))
    jaccard.similarity_classes(texts(docs))
    assert 0 < sum(came) < jaccard.COUNTERS  # one vector of the counters alone has eight times as many bytes
    found = np.concatenate([jaccard.shingles((r[1] or "").encode()) for r in rows])
    counters = np.bincount(jaccard.counter_of(found), minlength=jaccard.COUNTERS)
    want = np.floor(np.log2(np.maximum(1, counters / max(1, len(found) / jaccard.COUNTERS))))
    level, parts = jaccard.common(jaccard.measured(texts(docs)))
    assert (level == want).all() and want.max() > 1
    assert (parts == np.where(want > 0, np.floor(np.log2(np.clip(counters // 2, 1, 32_768))), 0)).all() and parts.max() > 0


def test_one_of_each_keeps_the_smallest(docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in linked_components([(r[0], r[1]) for r in rows]) if i == c and i is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_one_of_each_decides_by_row(spark):
    rng = random.Random(12)
    near, other, clean, own = (prose(rng, 60) for _ in range(4))
    copy = near + " end"
    rows = [(1, near), (2, copy), (2, other), (3, own), (4, near), (4, None), (4, ""), (None, copy), (None, near), (None, clean), (None, clean), (None, None), (None, " ")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(r for r in rows if r not in [(2, copy), (4, near)])


def removed(rows, depth):
    seen, out = set(), {}
    for i, text in sorted({(-1 if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], zlib.crc32(r[1].encode()))):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            if data[p : p + depth] in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(data[p : p + depth])
        out[i, text] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize(("depth", "digit"), [(100, 32), (20, 7)])
def test_radix_removes_every_repeat(docs, rows, depth, digit):
    want = removed([(r[0], r[1]) for r in rows], depth)
    for r in radix.repeats(texts(docs), depth, digit).collect():
        kept = radix.without(r.text.encode(), radix.covered(r.places, r.sizes, depth))
        assert kept == want[-1 if r.doc_id < 0 else r.doc_id, r.text], r.doc_id


def test_radix_blocks_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    data = [(i, bytes(rng.choice(b"ab") for _ in range(700)).decode()) for i in range(4)]
    data.append((9, data[1][1][200:500] * 2))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(radix, "BLOCK", 64)
    monkeypatch.setattr(radix, "CHUNK", 500)
    want = removed(data, 12)
    for r in radix.repeats(texts(docs), 12, 5).collect():
        assert radix.without(r.text.encode(), radix.covered(r.places, r.sizes, 12)) == want[r.doc_id, r.text]


def test_radix_stage_keeps_columns_and_whole_characters(docs):
    out = radix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[81].text is None
    assert set(by_id[85].text) <= {"é"} and set(by_id[86].text or "") <= {"é", "ü"}


def test_whole_signs():
    data = "aéb".encode()
    assert radix.whole_signs(data, [(0, 2)]) == [(0, 1)]
    assert radix.whole_signs(data, [(2, 4)]) == [(3, 4)]
    assert radix.whole_signs(data, [(2, 3)]) == []


def test_pack_round_trip(docs, rows):
    cut = pack.pieces(texts(docs), pack.default_tokenizer(), with_ids=True)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pack.default_tokenizer())
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    placed = pack.packed(cut).collect()
    by_place = sorted(placed, key=lambda r: (r.sequence_id, r.offset))
    ends: dict[int, int] = {}
    for r in by_place:
        assert r.offset == ends.get(r.sequence_id, 0) and r.length == len(r.ids) and r.offset + r.length <= 1024
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        ends[r.sequence_id] = r.offset + r.length
    found = Counter()
    for i, ids in want:
        own = [r for r in placed if (None if r.doc_id < 0 else r.doc_id) == i]
        first = len(ids) % 1024 or 1024
        for k in range(-(-len(ids) // 1024)):
            a, b = (0, first) if k == 0 else (first + 1024 * (k - 1), first + 1024 * k)
            assert any(r.piece == k and r.start == a and tuple(r.ids) == ids[a:b] for r in own)
        found[i] += 1
    total = sum(r.length for r in placed)
    assert len(ends) <= -(-total // 1024) + 2


@pytest.mark.parametrize("text", ["", " ", "a b", " a  b ", "a \n b\n\n c\td  ", "x<|endoftext|> y", "it's 'tis  z", "　a b\x1c c", "日本 語 12 345!! ...   end ", "a\x85 b \n"])
def test_tokens_are_those_of_the_whole_text(text):
    tokens = pack.Tokens(pack.default_tokenizer())
    assert np.frombuffer(tokens(text), dtype="<u4").tolist() == tokens.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_all_pieces(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, dtype=np.int64)
    for length in rng.integers(1, 1025, 40 * 10**seed % 5000 + 3):
        counts[length] += 1
    runs = pack.plan(counts, groups=12)
    held = Counter()
    for lengths, times in runs:
        assert sum(lengths) <= 1024
        for x in lengths:
            held[x] += times
    assert held == Counter({i: int(n) for i, n in enumerate(counts) if n})


def edit_distance_in(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
        before = row
    return min(before)


@pytest.mark.parametrize("seed", range(30))
def test_occurrences_are_those_within_the_budget(seed):
    rng = random.Random(seed)
    item = decontaminate.plain("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 160))))[0].strip()
    signs = list(item)
    for _ in range(rng.randint(0, 10)):
        at, what = rng.randrange(len(signs)), rng.choice("sid")
        signs[at : at + (what != "i")] = [] if what == "d" else [rng.choice("xyz")]
    text = decontaminate.plain(prose(rng, 20) + "".join(signs) + prose(rng, 20))[0]
    index = decontaminate.Index([(1, item)])
    found, best = index.occurrences(text), edit_distance_in(item, text)
    assert bool(found) == (best <= index.budget[0])
    assert not found or (found[0][3] == best and edit_distance_in(item, text[found[0][1] : found[0][2]]) == best)


def test_matches_and_what_is_left(spark, docs, rows):
    passage = rows[75][1].split()
    items = spark.createDataFrame([(1, " ".join(passage[25:60]).upper()), (2, None), (3, "short"), (4, "absent " * 20)], "item_id long, text string")
    found = decontaminate.matches(texts(docs), items).collect()
    hit = {r.doc_id for r in found}
    assert {r.item_id for r in found} == {1} and len(hit) == 8
    text = dict((r[0], r[1]) for r in rows)
    assert all(text[r.doc_id][r.start : r.end] == " ".join(passage[25:60]) for r in found)
    left = decontaminate.uncontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 8


def test_short_items_are_whole_words(spark):
    data = [(0, "The answer:  42!"), (1, "answer 421"), (2, "C++ and c+"), (3, "xyes no"), (4, "Yes. YES, yes"), (5, "new\n york, a new yorker"), (6, None), (7, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    items = spark.createDataFrame([(1, "42"), (2, "c++"), (3, "yes"), (4, "New York"), (5, ""), (6, " "), (7, "yes"), (8, "a long enough item that is absent")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.matches(texts(docs), items).collect()}
    want = {(0, 1, 13, 15, 0), (2, 2, 0, 3, 0), (5, 4, 0, 9, 0)} | {(4, i, s, s + 3, 0) for i in (3, 7) for s in (0, 5, 10)}
    assert got == want
    assert {r.doc_id for r in decontaminate.uncontaminated(docs, items).collect()} == {1, 3, 6, 7}


def test_resampling_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, rng.randint(3, 120))) for i in range(300)]
    junk = [(1000 + i, " | ".join(prose(rng, 30).split()) + " ###") for i in range(40)]
    data = [*good, *junk, (2000, None), (2001, ""), (None, "w1 w2"), good[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, log_weight string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in (*good[::2], *junk[::2])] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    kept = resample.resample(docs, labels)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and not any(i >= 1000 and i < 2000 for i in ids if i is not None)
    assert ids[0] == 2 and ids[None] == 1 and ids[2000] == ids[2001] == 1 and len(ids) == 303
    assert resample.resample(docs, labels.limit(0)).count() == docs.count()


def test_texts_without_words_pass_any_cut(spark, monkeypatch, tmp_path):
    ratio = np.full(resample.BUCKETS, -1.0)
    ratio[resample.ngrams(b"good good")] = 1
    monkeypatch.setattr(resample, "fit", lambda docs, labels: resample.Model(ratio, 32.0))
    data = [*((i, "good good") for i in range(9)), *((100 + i, f"bad{i}") for i in range(90)), *((200 + i, t) for i, t in enumerate([None, "", " ", "\n\t "])), (None, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = Counter(i for i, t in data if not (t or "").startswith("bad"))
    assert Counter(r.doc_id for r in resample.resample(docs, docs).collect()) == want
    for name in ("documents", "labels"):
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
    got = resample.quality_resampling(spark, str(tmp_path)).collect()
    assert Counter(None if r.doc_id < 0 else r.doc_id for r in got) == want and all((r.key is None) == (r.log_weight == 0) for r in got)


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(0, 5, 500)] + [3.25] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 520):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", 0) is None and kth_largest(df.limit(0), "x", 3) is None


def test_toxicity_learns_a_pair():
    rng = random.Random(3)
    found, toxic = [], []
    for _ in range(3000):
        words, a, b = prose(rng, 12), rng.random() < 0.4, rng.random() < 0.4
        found.append(toxicity.terms(f"{words} {'insult' * a} {'group' * b}".encode()))
        toxic.append(float(a and b))
    machine = toxicity.fit(found[:2000], np.array(toxic[:2000]))
    raw = np.array([machine.raw(x) for x in found[2000:]])
    assert ((raw > 0) == (np.array(toxic[2000:]) > 0)).mean() > 0.98


def test_toxicity_scores_all(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, toxic int")
    scores = toxicity.scored(texts(docs), toxicity.fit(*toxicity.sample(texts(docs), labels))).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.fit(*toxicity.sample(texts(docs), labels.limit(0))).score(b"") == 0.5


def test_flow_is_cheapest():
    flow = reshard.cheapest_flow([5, 9, 0], [4, 4, 6], lambda i, j: int(i != j))
    assert sum(x for (i, j), x in flow.items() if i != j) == 6 and sum(flow.values()) == 14


def test_resharding(docs, rows, tmp_path):
    from pyspark.sql import functions as F

    old = F.when(F.col("source").isNotNull(), F.length("source") + 1).cast("int")
    out = reshard.resharded(docs, old, 4)
    got = out.collect()
    assert len(got) == len(rows)
    for shard in range(4):
        assert sorted(r["__slot"] for r in got if r["__shard"] == shard) == list(range(sum(r["__shard"] == shard for r in got)))
    reshard.write_shards(out, str(tmp_path / "shards"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() <= len(rows) and {r.doc_id for r in back.select("doc_id").collect()} <= {r[0] for r in rows}


def test_top_k_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    data += [(400, data[3][1]), (401, None), (402, [1.0, None]), (403, [float("nan")]), (404, [float("inf")]), (405, []), (None, [1.0]), (406, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, rank int").repartition(3)
    monkeypatch.setattr(topk, "ROWS", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows = topk.vectors(df)
    from pyspark.sql import functions as F

    got = topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0)).collect()
    vs = {r.vec_id: np.array(list(r.v) + [0] * (6 - len(r.v))) for r in rows.collect()}
    assert set(vs) == set(range(300)) | {400, 406}
    for q in range(0, 401, 50):
        if q in vs:
            want = sorted(((-int(vs[q] @ v), i) for i, v in vs.items() if i != q))[:5]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


@pytest.fixture(scope="module")
def pages(spark):
    data = [(i, f"http://h{i % 2}.example/{i}", f"<html><body><p>page {i % 9}</p></body></html>" * (i % 4)) for i in range(40)]
    data += [(50, None, None), (51, "x\r\ny", ""), (None, "u", "é")]
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in data], "page_id long, url string, html string, error int").repartition(3)


def test_warc_round_trip(pages):
    stored = warc.archives(pages)
    back = warc.read(stored).collect()
    data = [(r.page_id if r.page_id is not None else warc.NO_ID, (r.html or "").encode()) for r in pages.collect()]
    first: dict[bytes, int] = {}
    for i, h in sorted(data):
        first.setdefault(h, i)
    want = {(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), None if first[h] == i else first[h], h if first[h] == i else None) for i, h in data}
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back}
    assert got == want and not any(r.error for r in back)


def test_warc_faults_are_rows():
    import zstandard

    dictionary = warc.record(0, "http://", b"", None)
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    good = warc.record(1, "http://a", b"text", None)
    bad = [good.replace(b"text", b"tExt"), good.replace(b"WARC/1.1", b"WARX/1.1"), good[:-2], good.replace(b"Content-Length: 8", b"Content-Length: 7"), good + good]
    frames = [coder.compress(x) for x in (good, *bad, warc.record(2, "", b"", 1))]
    found = list(warc.records(warc.leading(dictionary) + b"".join(frames)))
    assert [bool(e) for _, e in found] == [False, *[True] * 5, False] and found[-1][0]["refers_to"] == 1
    whole = warc.leading(dictionary) + frames[0]
    assert list(warc.records(whole[:-3]))[-1][1] and list(warc.records(frames[0]))[0][1] and list(warc.records(b""))[0][1]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><header><h2>Site</h2></header>%s<aside>side</aside><form><input><label>mail</label></form>
<div id="comments"><p>First!</p></div><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>f&eacute;e <b>x</b>y</article>", "A & B\none two three\nfée xy"),
        ("<main><article><p>k</p><div class=ad>buy</div><section class='comments'><p>no</p></section></article></main>", "k"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>1 < 2 &lt; 3</article>", "a\nb\nc\nd\n1 < 2 < 3"),
        ("<div class=content><p>only</p></div>", "only"),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_main_text(body, want):
    root = templates.tree(PAGE % body if "cut" not in body else "<html><body>" + body)
    templates.hashed(root)
    assert templates.main_text(root, templates.articles(root), set()) == want


def test_template_of_a_site_goes(spark):
    def page(i, host, box):
        return (i, f"https://{host}/{i}", f"<body><div class=x{host[0]}><div>Same on every page <i>{box}</i></div></div><div class=c><p>Text {i} of it.</p><p>shared line</p></div></body>")

    data = [page(i, "a.example", "A") for i in range(12)] + [page(100 + i, "b.example", f"B{i}") for i in range(12)] + [(300, None, None), (301, "b.example", "")]
    pages = spark.createDataFrame([(*r, "t") for r in data], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r.text for r in templates.extracted(pages).collect()}
    assert got[3] == "Text 3 of it.\nshared line" and got[103] == "Same on every page B3\nText 103 of it.\nshared line" and got[300] == got[301] == ""
    assert len(got) == 26


def test_template_inside_the_article_goes(spark):
    def page(i):
        quoted = "<p>Quoted by some.</p><div class=q>Quoted in a box.</div>" if i < 8 else ""
        return (i, f"https://a.example/{i}", f"<body><article><h1>Head</h1><p>Text {i} of it.</p><div class=x1>Subscribe now <i>for free</i></div>{quoted}<p>All rights kept.</p></article></body>")

    copies = [(100 + i, f"https://b.example/{i}", "<article><p>Copied page.</p><div class=x1>Box.</div></article>") for i in range(9)]
    pages = spark.createDataFrame([page(i) for i in range(20)] + copies, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in templates.extracted(pages).collect()}
    want = {i: f"Head\nText {i} of it." + ("\nQuoted by some.\nQuoted in a box." if i < 8 else "") for i in range(20)}
    assert got == want | {100 + i: "Copied page.\nBox." for i in range(9)}


def test_deep_markup():
    root = templates.tree("<div>" * 20_000 + "x")
    templates.hashed(root)
    assert templates.main_text(root, templates.articles(root), set()) == "x"


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.similarity_classes(texts(empty)).count() == 0
    assert radix.without_repeats(empty).count() == 0
    assert resample.resample(empty, labels).count() == 0
    assert decontaminate.uncontaminated(empty, items).count() == 0 and decontaminate.matches(texts(empty), items).count() == 0
    assert pack.pack(empty).count() == 0
    vectors = topk.vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.archives(pages)).count() == 0 and templates.extracted(pages).count() == 0
    from pyspark.sql import functions as F

    assert reshard.resharded(empty, F.lit(0)).count() == 0


def near_group(size, words=110):
    """Copies of one text with a word of their own, which link with each other, and as many with two, which link only with those: the
    pivots, the smallest by class, are all of the second kind."""
    rng = random.Random(size)
    base = prose(rng, words)
    out = []
    while len(out) < size:
        text = base.split()
        for j in rng.sample(range(4, words - 4), 1 + len(out) % 2):
            text[j] = f"own{rng.random()}"
        if (jaccard.class_id(jaccard.shingles(" ".join(text).encode())) < 0) == len(out) % 2:
            out.append((len(out), " ".join(text)))
    return out


def test_jaccard_asks_in_proportion_to_a_group_of_near_copies(spark, monkeypatch):
    asked = []
    distances = jaccard.distances

    def counted(pairs, classes, docs):
        asked.append(pairs.count())
        return distances(pairs, classes, docs)

    monkeypatch.setattr(jaccard, "distances", counted)
    seen = {}
    for size in (40, 200):
        asked.clear()
        rows = near_group(size)
        got = jaccard.similarity_classes(texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_components(rows)
        seen[size] = sum(asked)
    assert seen[200] <= 8 * seen[40]


def test_jaccard_blocks_of_a_region(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 7)
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    monkeypatch.setattr(jaccard, "FURTHER", 2)
    rows = near_group(60)
    got = jaccard.similarity_classes(texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_components(rows)
