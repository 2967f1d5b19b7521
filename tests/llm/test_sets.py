"""Operators on whole sets of rows: join, mixing, packing, neighbours, WARC records and the pipeline."""

import gzip
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tracewright.llm import mixing, nearest, ngram_join, packing, warc
from tracewright.session import scratch


def grams(t):
    w = (t or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def joined(rows):
    """class and links of every row, by comparing all pairs."""
    sets, root, links = [grams(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, low[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(rng.randrange(300))
    rows, base = [], [word() for _ in range(120)]
    for k in range(60):  # near copies of near copies
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = word()
        rows.append((k, " ".join(t)))
    rows += [(100 + k, " ".join(base[:20] + [word() for _ in range(80)])) for k in range(30)]  # a shared passage
    rows += [(200 + k, " ".join([word() for _ in range(rng.choice([1, 3, 5, 40]))])) for k in range(30)]
    same = " ".join(word() for _ in range(50))
    rows += [(300 + k, same.replace(" ", "\n") if k % 2 else same) for k in range(20)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "a b"), (404, "a  b"), (405, "a b c")]
    rows += [(300, same), (7, " ".join(word() for _ in range(30))), (500, " ".join(word() for _ in range(20000)))]
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_join_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(3)
    got = ngram_join.join(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == joined(rows)


def test_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.class_id, r.n_links) for r in ngram_join.join(docs).collect())
    assert got == [(0, None, 0), (0, None, 0), (3, 3, 0)]
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_pruning_bound_is_the_posterior():
    for k, need in enumerate(ngram_join.least_equal(), 1):
        n = 32 * k
        s = (np.arange(200_000) + 0.5) / 200_000

        def beyond(m):
            f = np.exp(m * np.log(s) + (n - m) * np.log1p(-s) - max(m * np.log(s) + (n - m) * np.log1p(-s)))
            return f[s >= 0.8].sum() / f.sum()

        assert beyond(need) >= ngram_join.TOLERANCE > beyond(need - 1)


def water(sizes, weights):
    """Targets by cutting what is above its cap and sharing the excess again, until none is."""
    total, capped, target = 1.5 * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(2 * sizes[k] for k in capped)
        free = [k for k in range(len(sizes)) if k not in capped]
        over = [k for k in free if rest * weights[k] / sum(weights[j] for j in free) > 2 * sizes[k]]
        if not over:
            return [2.0 * sizes[k] if k in capped else rest * weights[k] / sum(weights[j] for j in free) for k in range(len(sizes))]
        capped |= set(over)


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["b", "a", "ä", "Z", None, "hot", "hot", "hot"]), 1) for k in range(400)]
    rows += [(1000, None, "a", 1), (1001, "", "empty", 1), (1002, "x " * 5000, "hot", 1), (None, "x y", "b", 1), (5, rows[5][1], rows[5][2], 1), (5, rows[5][1], rows[5][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mix(docs).collect()
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode("utf-32-be")) + [None]
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    want = dict(zip(names, water([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    of = Counter((r[0], len((r[1] or "").split())) for r in rows)
    assert Counter((r.doc_id, r.size) for r in got) == of
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(tuple, mixing.mix(docs.repartition(2)).select("size", "taken").collect())) == sorted((r.size, r.taken) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_tells_the_place_of_every_part(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(3)
    few = [(5000 + k, "one word or more", f"few{k:03}") for k in range(300)]  # sources that the points may leave out
    docs = spark.createDataFrame([(k, "w " * rng.randrange(0, 130), rng.choice("aabc")) for k in range(600)] + few, "doc_id long, text string, source string").repartition(4)
    got = mixing.parts(docs).collect()
    sums = Counter()
    for r in got:
        sums[r.doc_id] += r.taken
    assert sums == Counter({r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken})
    source = {r.doc_id: r.source for r in docs.collect()}
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append((r.place, r.taken, source[r.doc_id]))
    for held in slots.values():  # a slot is a block of one source, filled from its first word on without a gap
        end = 0
        for place, n, _ in sorted(held):
            assert place == end
            end += n
        assert end <= 50 and len({s for *_, s in held}) == 1
    spans = sorted((r.doc_id, r.slot, r.before, r.taken) for r in got)
    assert all(0 <= b and n > 0 for *_, b, n in spans)
    big = [s for _, held in sorted(slots.items()) for s in [held[0][2]] if s in "abc"]
    whole = Counter(big)
    for k in range(1, 9):  # in proportion in every stretch
        part = Counter(big[: len(big) * k // 8])
        assert all(abs(part[s] - whole[s] * k / 8) < 6 for s in whole), (k, part, whole)


def test_pipeline_mix_is_in_the_order_of_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    docs = spark.createDataFrame([(k, f"w{k} " * (k % 90 + 1), "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string").repartition(3)
    path = scratch(spark, "test")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(path)
    files = sorted(f.split("?")[0] for f in spark.read.parquet(path).inputFiles())
    got = [r.doc_id for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    taken, opened = Counter(), {}
    for r in mixing.parts(docs).collect():
        taken[r.doc_id] += r.taken
        if r.before == 0:
            opened.setdefault(r.doc_id, []).append((r.slot, r.place))
    from decimal import ROUND_HALF_UP, Decimal

    copies = {k: int((Decimal(n) / (k % 90 + 1)).quantize(Decimal(1), ROUND_HALF_UP)) for k, n in taken.items()}
    assert got == [k for _, k in sorted((at, k) for k, places in opened.items() for at in sorted(places)[: copies[k]])]


def test_schedule_is_even_everywhere(spark):
    shares = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "no long, target double")
    got = mixing.schedule(shares, 6000).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(6000))
    seen = Counter()
    for k, r in enumerate(got, 1):
        assert r.r == seen[r.no]
        seen[r.no] += 1
        assert all(abs(seen[no] - k * w / 6) < 4 for no, w in ((1, 3), (2, 1), (3, 2)))


def test_tokens_are_those_of_the_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    texts = [None, "", " ", "a", "it's  ünïcode\n\n\t 数字 ١٢٣ ²½ ​\x85　x", "<|endoftext|> 😀👩‍👩‍👧", "x" * 9000, "word " * 3000, "word " * 2047, "Ⅷ ǅ ʰ �"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(2)
    got = packing.pieces(docs, length=64, ids=True).orderBy("doc_id", "piece").collect()
    for k, t in enumerate(texts):
        ids = known.encode(t or "", add_special_tokens=False).ids + [0]
        own = [r for r in got if r.doc_id == k]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert all(r.length == 64 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(k % 900, k, 0, 0, rng.choice([1, 7, 60, 33, 34, 50, 51, 64, rng.randrange(1, 65)]), k) for k in range(3000)] + [(None, 1, 0, 0, 5, 1)] * 700
    pieces = spark.createDataFrame(rows, packing.PIECE)
    got = packing.pack(pieces, length=64, group=256).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == Counter((r[0], r[4], r[5]) for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, n in sorted(b):
            assert offset == end
            end += n
        assert end <= 64
    bound = packing.lower_bound(np.array([r[4] for r in rows]), 64)
    assert bound <= len(bins) <= 1.02 * bound
    assert packing.pack(pieces.limit(0)).count() == 0


def test_lower_bound_never_exceeds_the_best_packing():
    def fewest(sizes):
        best = [len(sizes)]

        def place(k, room):
            if len(room) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(room)
                return
            for i in range(len(room)):
                if room[i] >= sizes[k]:
                    place(k + 1, [*room[:i], room[i] - sizes[k], *room[i + 1 :]])
            place(k + 1, [*room, 20 - sizes[k]])

        place(0, [])
        return best[0]

    rng = random.Random(6)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 21) for _ in range(7)), reverse=True)
        bins, _ = packing.best_fit(sizes, 20)
        assert packing.lower_bound(np.array(sizes), 20) <= fewest(sizes) <= max(bins) + 1
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 24)) + 2 * rng.standard_normal((10, 24))[np.arange(2000) % 10]
    x[1200:1800] = x[7]  # a hot vector
    x[1] *= 1e200
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(3000, None, 1), (3050, [], 1), (3100, [0.0] * 24, 1), (3150, [float("nan")] * 24, 1), (3200, [None, *[1.0] * 23], 1), (3250, [float("inf")] * 24, 1), (None, x[0].tolist(), 1), (3300, [1.0], 1)]
    base = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = nearest.search(base, base.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 2000, 50)) and all(len(v) == 5 for v in by.values())
    u = x / np.abs(x).max(1, keepdims=True)
    norm, hits = np.sqrt((u * u).sum(1)), 0
    for q, found in by.items():
        s = (u * u[q]).sum(1) / (norm * norm[q])
        assert all(abs(s[v] - c) < 1e-12 and v != q for v, c in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        s[q] = -9
        best = np.lexsort((np.arange(2000), -s))[:5]
        hits += len({v for v, _ in found} & set(best.tolist()))
        if 1200 <= q < 1800:
            assert [v for v, _ in found] == [7, *[v for v in range(1200, 1206) if v != q]][:5]
    assert hits >= 0.9 * 5 * len(by)


def test_few_or_no_neighbours(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = nearest.search(base, base.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)] and got[1].score == -1
    assert nearest.search(base.limit(0), base).count() == 0
    assert nearest.search(base.where("vec_id = 0"), base.where("vec_id = 0")).count() == 0


def test_repeated_queries_and_ids(spark):
    """A repeated row is one query; an id with two vectors is two."""
    base = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(40)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (101, [1.0, 0.0]), (101, [0.0, 1.0])], base.schema)
    got = nearest.search(base.union(base.where("vec_id = 0")), asked, 4).collect()
    near = lambda x, y: sorted(range(40), key=lambda k: (-(x * np.cos(k) + y * np.sin(k)), k))
    east, north = [0, 0, *near(1, 0)[1:3]], near(0, 1)[:4]
    rows = lambda q: sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
    assert rows(100) == list(zip(range(1, 5), east))
    assert rows(101) == sorted([*zip(range(1, 5), east), *zip(range(1, 5), north)])


def test_warc_repeated_fields_lengths_and_broken_files(spark, tmp_path):
    def record(block, length=None):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    cookies = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1, b\r\nset-cookie: c=2\r\nVary: x\r\nVary: y\r\nContent-Type: text/html\r\n\r\n<p>one</p>"
    rows = [(1, record(cookies)), (2, record(cookies, -7))]
    got = {(r.key, r.warc_type): r for r in warc.derivatives(spark.createDataFrame(rows, "key long, record binary"), "key").collect()}
    one = got[1, "conversion"]
    assert one.block == "one" and one.http_headers["set-cookie"] == "a=1, b\nc=2" and one.http_headers["vary"] == "x, y"
    assert got[2, None].error == "negative length" and len(got) == 3
    whole = [record(b"HTTP/1.1 200 OK\r\n\r\n" + bytes(str(k), "ascii") * 5000) for k in range(30)]
    packed = b"".join(gzip.compress(x) for x in whole)
    (tmp_path / "a.warc.gz").write_bytes(packed)
    (tmp_path / "b.warc").write_bytes(b"".join(whole))
    (tmp_path / "c.warc.gz").write_bytes(packed[:-30])
    (tmp_path / "d.warc").write_bytes(b"".join(whole)[:-200])
    (tmp_path / "e.warc").write_bytes(b"")
    by = {}
    for r in warc.read_warc(spark, str(tmp_path)).collect():
        by.setdefault(r.path.split("/")[-1][0], []).append(bytes(r.record))
    assert by["a"] == by["b"] == whole and "e" not in by
    assert by["c"][:29] == by["d"][:29] == whole[:29] and len(by["c"]) in (29, 30) and len(by["d"]) == 30
    cut = spark.createDataFrame([(k, by["d"][k]) for k in (0, 29)], "key long, record binary")
    assert {(r.key, r.error) for r in warc.derivatives(cut, "key").collect()} == {(0, None), (29, "record is cut off")}


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/x", "<html><head><title>T &amp; U</title></head><body><p>One<br>two <a href='/l'>link</a></p><script>x</script>é"), (2, None, None), (3, "http://b.example/", ""), (1, "http://a.example/x", "<p>again</p>"), (4, "u", "word " * 300000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string")
    sources = warc.responses(pages)
    got = warc.derivatives(sources, "page_id").collect()
    assert Counter((r.page_id, r.warc_type) for r in got) == Counter((i, k) for i, *_ in rows for k in ("metadata", "conversion"))
    from_source = {warc.parsed(bytes(r.record))[0]["warc-record-id"]: warc.parsed(bytes(r.record)) for r in sources.collect()}
    assert len(from_source) == len(rows)
    for r in got:
        fields, block = warc.parsed(bytes(r.record))
        source, _ = from_source[r.refers_to]
        assert fields["warc-refers-to"] == r.refers_to and fields["warc-payload-digest"] == source["warc-payload-digest"]
        assert fields.get("warc-refers-to-target-uri") == source.get("warc-target-uri") and fields["warc-refers-to-date"] == source["warc-date"]
        assert block == r.block.encode() and fields["warc-block-digest"] == warc.digest(block)
        assert r.http_headers["content-type"] == "text/html; charset=utf-8" and r.http_status == 200
    text = {r.page_id: r.block for r in got if r.warc_type == "conversion" and "again" not in r.block}
    assert text[1] == "One\ntwo link\né" and text[2] == text[3] == "" and len(text[4]) == 1499999
    facts = next(r.block for r in got if r.page_id == 1 and r.warc_type == "metadata" and "T & U" in r.block)
    assert "outlink: /l\r\n" in facts and "http-header-content-type: text/html; charset=utf-8\r\n" in facts
    again = warc.derivatives(sources.repartition(3), "page_id")
    assert sorted(r.record_id for r in again.collect()) == sorted(r.record_id for r in got)

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in sources.collect()))
    assert sorted(bytes(r.record) for r in warc.read_warc(spark, str(tmp_path / "a.warc.gz")).collect()) == sorted(bytes(r.record) for r in sources.collect())


def test_plain_text_of_pages_without_end_tags():
    body = "<p>One<p>two <b>three</b>"
    for page in (
        "<head><title>T</title><meta charset=utf-8><script>x</script><style>y</style><body>{}", "<HEAD lang=en><TITLE>T</TITLE>{}",
        "<head><title>T</title></head>{}", "<body><svg class=a>{}", "<svg/>{}<svg><title>T</title></svg>", "<noscript>{}", "<template><!-- x -->{}",
        "<svg-icon>{}", "<script>a('<!--')</script >{}<!-- <p>no", "{}<script>var code = '<p>no';",
    ):
        assert warc.plain(page.replace("{}", body)) == "One\ntwo three", page
    assert warc.plain("<title>T</title><p>x") == "T\nx"
    assert warc.plain("<svg>" * 200_000 + body) == "One\ntwo three"


def test_warc_of_odd_records(spark):
    packed = gzip.compress("<p>ü".encode("latin-1"))
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed)
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nX-A: b\r\n c\r\n\r\n" + chunked
    good = warc.written([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block)
    other = warc.written([("WARC-Type", "request")], b"x")
    rows = [(1, good), (2, other), (3, None), (4, b"junk"), (5, good[:-20])]
    got = warc.derivatives(spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in rows], "k int, record binary"), "k").collect()
    assert sorted((r.k, r.warc_type or "", r.error or "") for r in got) == [
        (1, "conversion", ""), (1, "metadata", ""), (4, "", "no WARC record"), (5, "", "record is cut off"),
    ]
    one = next(r for r in got if r.warc_type == "conversion")
    assert one.block == "ü" and one.http_status == 404 and one.http_headers["x-a"] == "b c"
    assert warc.derivatives(spark.createDataFrame([], "k int, record binary"), "k").count() == 0


def test_pipeline(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(n))
    rows = [(k, line(90), "aa", rng.choice(["s", "t", None]), k, 1) for k in range(60)]
    rows += [(100 + k, rows[0][1] + f" end{k}", "aa", "s", 1, 1) for k in range(5)]  # near copies of 0
    rows += [(200, None, "aa", "s", 1, 1), (201, "", None, "s", 1, 1), (202, "12 34 " * 50, "aa", "s", 1, 1), (203, "few words", "aa", "s", 1, 1)]
    rows += [rows[3], rows[3], (None, line(70), "aa", "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, turn int").repartition(3)
    state = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "test")
        stage(spark, state, "").write.parquet(path)
        state = spark.read.parquet(path)
        seen.append(state)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == docs.columns
    ids = [Counter(r.doc_id for r in s.collect()) for s in seen]
    assert not {200, 201, 202} & set(ids[0]) and ids[0][203] == 1 and ids[0][3] == 3
    assert 203 not in ids[1] and sum(ids[1].values()) == 68
    assert ids[2] == Counter([*range(60), None])
    words = lambda s: sum(len(r.text.split()) for r in s.collect())
    assert abs(words(seen[3]) - 1.5 * words(seen[2])) <= 3 * 90 and max(ids[3].values()) <= 2
    assert sum(r.length for r in seen[4].collect()) == sum(r.length for r in packing.pieces(seen[3]).collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_mix_of_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 5 + [(None, "d e f", "s")] * 4 + [(k, "g h i", "s") for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += int(r.taken / r.size + 0.5)
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == +want


def test_probes_follow_the_clusters_of_the_vectors():
    rng = np.random.default_rng(4)
    even = nearest.unit(rng.standard_normal((4000, 32)))
    middle = rng.standard_normal((60, 32))
    clustered = nearest.unit(middle[rng.integers(0, 60, 4000)] + 0.05 * rng.standard_normal((4000, 32)))
    few, many = (nearest.enough_probes(x, nearest.centres(x, 60), 5) for x in (clustered, even))
    assert few <= 4 and 20 < many <= 60
    # Copies are one vector: they don't make a scattered table look clustered.
    assert nearest.enough_probes(np.concatenate([even, np.repeat(even[:1], 8000, 0)]), nearest.centres(even, 60), 5) == many
    assert nearest.enough_probes(even[:5], even[:3], 5) == 3 and nearest.enough_probes(even[:0], even[:3], 5) == 3
    probes, c = nearest.enough_probes(even, nearest.centres(even, 60), 5), nearest.centres(even, 60)
    lists, order = (even @ c.T).argmax(1), np.argsort(-(even @ c.T), axis=1)
    found = 0
    for i in range(0, 4000, 40):
        near = even @ even[i]
        near[i] = -9
        found += np.isin(lists[np.argsort(-near)[:5]], order[i, :probes]).sum()
    assert found >= 0.92 * 500
