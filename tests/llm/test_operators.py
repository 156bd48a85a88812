"""Each operator against a brute-force version on a small fixture, and on empty tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, counts, decontaminate, langid, lines, pieces, simhash, substring, tokens, topk, urls
from tests.llm.texts import SCHEMA, frame, rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def table(df):
    return Counter(map(tuple, df.collect()))


def classes(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def fingerprint(text, k=3, seed=42):
    w = WORD.findall((text or "").encode().lower())
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=seed) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def shingles(text, k=5):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


# --- 1


def test_language_id_learns_and_stays_undecided_without_letters(spark):
    base = {"aa": "thetheth anan the and ", "bb": "éère queque les des ", "cc": "ungung der chsch die "}
    data = [(i, (t * (1 + i % 7)).strip(), lang, "s", 1, "x", 1, None) for lang, t in base.items() for i in range(20)]
    model = langid.fit(frame(spark, data))
    odd = [(1, "the and thetheth", None), (2, "éère les", None), (3, None, "aa"), (4, "", "bb"), (5, "123 !!", "aa"), (6, "der die ungung", "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, [(*x, "s", 1, "x", 1, None) for x in odd]), model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "cc"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.keep_known(frame(spark, [(*x, "s", 1, "x", 1, None) for x in odd]), model, least=0.2).count() == 3
    assert langid.predict(frame(spark, []), langid.fit(frame(spark, []))).count() == 0


def test_language_masks_hold_every_learned_gram_of_over_64_languages():
    rnd = np.random.default_rng(1)
    held = {f"l{k:03}": rnd.integers(0, 2**63, 50).astype(np.uint64) for k in range(70)}
    model = langid.Model.fit(held)
    for k, lang in enumerate(model.languages):
        one, two = model.rows(held[lang])
        assert ((model.table[k // 64, one] & model.table[k // 64, two]) >> np.uint64(k % 64) & np.uint64(1)).all()


def test_language_grams_and_counts_by_hand(monkeypatch):
    import random

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        x = " " + " ".join(words) + " " if words else ""
        return Counter(x.ljust(4)[i : i + 4] for i in range(max(1, len(x) - 3))) if words else Counter()

    rnd = random.Random(5)
    odd = ["", "a", "ab", "...", " 1 a", "İstanbul ΟΔΟΣ Σ", "x" * 50, "a..b,,c  d"] + ["".join(rnd.choice("abcÉñ日 .,1\n") for _ in range(rnd.randrange(80))) for _ in range(300)]
    held = {"p": grams(" ".join(odd[:100])), "q": grams(" ".join(odd[100:200]))}
    code = lambda g: langid._grams(np.array([ord(c) for c in g], np.uint32))[0]
    model = langid.Model.fit({k: np.array([code(g) for g in v], np.uint64) for k, v in held.items()})
    whole = {t: np.sort(np.concatenate([np.zeros(0, np.uint64), *langid.text_grams(t)])).tolist() for t in odd}
    for block in (1 << 20, 7, 1):
        monkeypatch.setattr(langid, "BLOCK", block)
        for t in odd:
            assert np.sort(np.concatenate([np.zeros(0, np.uint64), *langid.text_grams(t)])).tolist() == whole[t], (t, block)
    for t in odd:
        want = grams(t)
        assert whole[t] == sorted(int(code(g)) for g in want.elements()), t
        n, hits = model.counts(t)
        assert n == sum(want.values())
        by_set = [sum(c for g, c in want.items() if g in held[k]) for k in ("p", "q")]
        assert all(a <= b <= a + 0.1 * n for a, b in zip(by_set, hits.tolist(), strict=True))


def test_language_id_held_out_accuracy(spark):
    from graphloom.llm.registry import op1_language_id

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in op1_language_id(spark, sf).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.97 * len(out)


# --- 2


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 3, 3, 700, 100000], list(range(0, 90000, 7)), [0] * 700 + [10**12] * 700 + [10**13]])
def test_elias_fano_round_trip(values):
    import io

    f = io.BytesIO()
    tokens.EliasFano.of(np.array(values, np.uint64)).dump(f)
    size = f.tell()
    f.seek(0)
    e = tokens.EliasFano.load(f)
    assert e.part(0, e.n).tolist() == values
    assert [e.select(i) for i in range(0, len(values), 13)] == values[::13]
    for i in range(0, len(values) + 1, 1 + len(values) // 9):
        for j in range(i, len(values) + 1, 1 + len(values) // 7):
            assert e.part(i, j).tolist() == values[i:j]
    assert size < 60 + len(values) * 8 if values else True


def shard_rows():
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|> ", "it's\ttab \x1c \x85 é\xa0 x", "a  b   c \n\n d ", " lead", "tail \n", "日本語 テキスト 😀", "<|endoftext", "w " * 90_000]
    return rows() + [(2000 + i, t, "en", "s", 1, "x", 1, None) for i, t in enumerate(odd)]


def test_shards_hold_what_the_library_gives(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = shard_rows()
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in data]
    assert any(50256 in x for _, x in ids)
    out = tokens.encode_to_shards(frame(spark, data), P.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/s").collect()
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted([r.doc_id for r in out], key=lambda x: (x is not None, x or 0))
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    again = tokens.read_documents(spark, f"file://{tmp_path}/s", ids=True).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in again) == Counter((i, tuple(x)) for i, x in ids)
    assert tokens.encode_to_shards(frame(spark, []), P.path("byte_bpe_50k.json"), folder=f"file://{tmp_path}/e").count() == 0


def test_small_read_blocks_and_single_shards_read_the_same(spark, tmp_path):
    import io

    rnd = np.random.default_rng(9)
    sizes = rnd.integers(1, 50, 1000)
    ids = np.sort(rnd.integers(-(10**9), 10**9, 990))
    f = io.BytesIO()
    tokens.dump_bounds(f, np.cumsum(sizes), ids, 10, 2)
    f.seek(0)
    b = tokens.Bounds(f)
    at, seen, edges = 0, [], [0]
    while at < len(b):
        to = b.until(at, 300)
        edge = b.edges(at, to)
        assert edge[0] == edges[-1] and (to == at + 1 or edge[-1] - edge[0] <= 300)
        edges += edge[1:].tolist()
        seen += b.documents(at, to)
        at = to
    assert seen == [None] * 10 + ids.tolist() and edges == [0, *np.cumsum(sizes).tolist()]


def test_encoders_cut_texts_only_where_that_is_safe():
    from tokenizers import Tokenizer

    rnd = __import__("random").Random(4)
    odd = ["".join(rnd.choice("ab \n\t's1.,!é\xa0\x1c日X") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    odd += ["it's' dog's. we'll!! x1, 'll' a'.b,c;; d''s", "word word, word,, word. Word! word'"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = Tokenizer.from_file(P.path(name)), tokens.Encoder(P.path(name))
        e.pieces.spaced.remembered = 50
        assert e.pieces.whole == (name[:4] == "word")
        for text, got in zip(odd, e.run(odd), strict=True):
            assert np.frombuffer(got, e.kind).tolist() == t.encode(text, add_special_tokens=False).ids, text


# --- 3


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None, key=lambda x: (x[0], x[1], x[3] == "block"))
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("limit", [1000, 0])
def test_url_rules_both_ways(spark, limit):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.example.net", ""), ("allow", "b.a.example.net", "/en/x"), ("block", "com", "/d")]
    hosts = ["net", "x.net", "example.net", "EXAMPLE.net", "b.a.example.net", "aexample.net", "example.com", "q.org", "", "net.", "com"]
    urls_ = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?y#z", "/de/1", "/d", "/fr/#a")] * 2 + [None, "", "nothing", "a://b://c", "http://x.net?q=/en/", "HTTP://Ünet.NET/\n/en"]
    data = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls_)], "page_id long, url string, host string, rule int").repartition(3)
    rule_df = spark.createDataFrame([*rules, (None, "zz", "/"), ("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    got = {r.page_id: (r.host_, r.path, r.rule_, r.verdict) for r in urls.filter_urls(data, rule_df, limit=limit, ranges=4).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls_)}
    assert urls.filter_urls(data.limit(0), rule_df, limit=limit, ranges=4).count() == 0


def test_sweeps_may_start_anywhere():
    rules = [("block", h, "/") for h in ("net", "a.net", "b.a.net", "c.net", "zz.org", "org")]
    found = urls.hosts(rules)
    asked = [(h, "/x") for h in ("x.b.a.net", "b.a.net", "c.net", "cc.net", "org", "q.zz.org", "com")]
    want = [judged(f"http://{h}{p}", rules)[2:] for h, p in asked]
    assert urls.sweep(asked, found, [h.key for h in found]) == want
    assert [urls.sweep([x], found, [h.key for h in found])[0] for x in asked] == want
    assert urls.sweep([], found, [h.key for h in found]) == [] and urls.sweep(asked, [], []) == [(None, "allow")] * len(asked)


# --- 4


def without_repeats(data, window):
    starts = defaultdict(set)
    for i, t in data:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                starts[tuple(w[k : k + window])].add(i)
    out = Counter()
    for i, t in data:
        w = words_of(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if min(starts[tuple(w[k : k + window])]) < i:
                    gone.update(range(k, k + window))
        out[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("window", [50, 21, 16, 7, 2, 1])
def test_substring_dedup(spark, window):
    data = [r[:2] for r in rows()] + [(11, "x " * 80), (2, "x " * 60 + "y"), (12, " ".join(f"w{i % 9}" for i in range(300))), (1, " ".join(f"w{i % 9}" for i in range(3, 200)))]
    df = frame(spark, [(*r, "en", "s", 1, "x", 1, None) for r in data])
    assert table(substring.deduplicate_substrings(df, window=window)) == without_repeats(data, window)


def test_levels_halve_and_anchors_are_the_leftmost_least():
    assert [substring.levels(n) for n in (50, 32, 16, 15, 7, 1)] == [[13, 25, 50], [8, 16, 32], [8, 16], [8, 15], [7], [1]]
    x = np.random.default_rng(1).integers(0, 9, 400)
    for n in (1, 2, 5, 38):
        assert substring.leftmost_least(x, n).tolist() == [i + int(np.argmin(x[i : i + n])) for i in range(len(x) - n + 1)]


def test_substring_dedup_of_common_and_long_passages(spark, monkeypatch):
    import random

    monkeypatch.setattr(substring, "BLOCK", 1000)  # many blocks, and texts longer than one
    rnd = random.Random(12)
    passage = [f"p{rnd.randrange(10**6)}" for _ in range(120)]
    data = [(2, "la " * 3000)]
    for i in range(300):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 90))]
        if i % 3 == 0:  # a third of all documents hold one passage, whole or in part
            a = rnd.choice([0, 0, 0, 3, 50, 69])
            w[len(w) // 2 : len(w) // 2] = passage[a : rnd.choice([120, 120, 110, 100])]
        data.append((i, " ".join(w)))
    long = [f"l{rnd.randrange(50)}" for _ in range(6000)]
    data += [(400, " ".join(long)), (401, " ".join(long[1000:4000])), (402, "la " * 70), (None, " ".join(passage))]
    df = frame(spark, [(*r, "en", "s", 1, "x", 1, None) for r in data])
    got = table(substring.deduplicate_substrings(df))
    assert got == without_repeats(data, 50) and sum(k[2] > 0 for k in got) > 80


def test_substring_dedup_of_nothing(spark):
    assert substring.deduplicate_substrings(frame(spark, [])).count() == 0


# --- 5


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "LANE", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "STEP", 16)
    rnd = np.random.default_rng(2)
    x = np.round(rnd.normal(0, 0.3, (300, 12)) * 4) / 4 * rnd.choice([1, 1, 3], (300, 1)) * scale
    data = [(int(i), [float(y) for y in v], 1) for i, v in enumerate(x)]
    data += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (904, [], 1), (905, [0.5 * scale] * 3, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, id int").repartition(4)
    v = topk.quantize(df)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.where("id % 20 = 0"), 7).collect()}
    ints = {i: [int(np.floor(64 * y)) for y in e] for i, e, _ in data if i is not None and e is not None and all(y is not None and np.isfinite(y) for y in e)}
    want = {}
    for q in (i for i in ints if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q))[:7]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    unlike = v.where("id = 40").union(v.where("id = 41").withColumn("id", F.lit(40).cast("long")))
    least = min((40, 41), key=lambda i: [float(y) for y in ints[i]])
    got = [(r.vec_id, r.score) for r in topk.top_k(v, unlike, 3).orderBy("rank").collect()]
    assert got == [(c, -s) for s, c in sorted((-sum(a * b for a, b in zip(ints[least], ints[c], strict=False)), c) for c in ints if c != 40)[:3]]
    assert topk.top_k(v.limit(5), v.limit(1), 20).count() == 4


# --- 6


def library():
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_gives_the_library_s_ids(spark):
    enc = library()
    got = bpe.encode(frame(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = Counter()
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((*r[:4], tuple(r[4])) for r in got.collect()) == want
    assert bpe.encode(frame(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_replay_on_odd_texts_and_odd_ranks():
    import random

    enc, replay = library(), bpe.MergeReplay(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rnd = random.Random(3)
    odd = ["", " ", "\n", "a  b", "aaaaaaaaa aaaaaaaa", "it's  don't\n\n x\t\ty", "\x00b \x00c", "123 4 5  6", "x \n y", "日本 😀 é" * 9]
    odd += ["".join(rnd.choice("ab \n\t's1.é\xa0\x1c日") for _ in range(rnd.randrange(40))) for _ in range(2000)]
    for text, got in zip(odd, replay.encoder().run(odd), strict=True):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == enc.encode_ordinary(text), text
        assert replay.decode(ids) == text.encode()
    # ranks that training wouldn't give: a later merge outranks the one that made it possible
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 300, b"abc": 1, b"bc": 305, b"aa": 400, b"aaa": 2}
    import tiktoken

    own, odd_replay = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.MergeReplay(ranks, P.PATTERN)
    for text in ["abcabc", "aabcabab", "aaaaaaa", "aaabcaa", "bcabcab"] + ["".join(rnd.choice("abc") for _ in range(12)) for _ in range(300)]:
        assert np.frombuffer(next(odd_replay.encoder().run([text])), "<u4").tolist() == own.encode_ordinary(text), text


def test_pieces_forget_without_harm():
    p = pieces.Pieces(lambda raw: [x.encode() for x in raw], chunk=50, remembered=5)
    texts = [r[1] or "" for r in rows()]
    assert list(p.run(texts)) == [t.encode() for t in texts]


# --- 7


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = counts.load_vocabulary(P.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    extra = [(20, " lead"), (21, "▁mark  two"), (22, "😀 <0x0A> <s>"), (23, "tail "), (24, "日本語テキスト"), (25, "   ")]
    data = rows() + [(i, x, "en", "s", 1, "x", 1, None) for i, x in extra]
    want = Counter((r[0], len(t.encode(r[1]).ids) if r[1] else 0, len(r[1] or "")) for r in data)
    assert table(counts.token_counts(frame(spark, data), P.path("piece_bpe_32k.model"))) == want
    assert counts.token_counts(frame(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def test_token_count_ties_and_fused_unknowns():
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -2.0)]
    t, c = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False)), counts.Counter(vocabulary)
    for word in ("▁ab", "▁aba", "▁abab", "▁xx", "▁axxb", "▁xaxx", "▁bbbb", "▁abbaab"):
        assert c.word(word) == len(t.encode(word).ids), word


# --- 8


def test_simhash_components(spark):
    data = rows()
    fps = [fingerprint(r[1]) for r in data]
    root = classes(len(data), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {}
    for r, c in zip(data, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(data, fps, root, strict=True))
    assert table(simhash.near_duplicates(frame(spark))) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_of_large_buckets_connect_what_is_connected():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 4).astype(np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(x) for x in rnd.choice(64, rnd.integers(0, 6), replace=False))) for b in base for _ in range(80)], np.uint64))
    a, b = simhash.bucket_links(np.zeros(len(fps), np.int64), lambda a, b: np.bitwise_count(fps[a] ^ fps[b]) <= 2)
    linked = set(zip(a.tolist(), b.tolist(), strict=True))
    assert all((int(fps[x]) ^ int(fps[y])).bit_count() <= 2 for x, y in linked)
    want = classes(len(fps), lambda x, y: (int(fps[x]) ^ int(fps[y])).bit_count() <= 2)
    got = classes(len(fps), lambda x, y: (x, y) in linked or (y, x) in linked)
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got)) and len(linked) < len(fps)
    keys = list(simhash.radius_keys(fps.reshape(-1, 1), 2))
    for x in range(0, len(fps), 7):
        for y in range(x):
            if (int(fps[x]) ^ int(fps[y])).bit_count() <= 2:
                assert any(k[x] == k[y] for k in keys)


def test_near_duplicate_stage_keeps_one_of_a_group(spark):
    import random

    rnd = random.Random(4)
    texts = [" ".join(f"v{rnd.randrange(900)}" for _ in range(200)) for _ in range(20)]
    data = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:10]):
        w = t.split()
        w[rnd.randrange(200)] = "changed"
        data += [(100 + i, t), (200 + i, " ".join(w))]
    data += [(5, texts[5]), (None, texts[3]), (300, None), (301, "")]
    out = simhash.drop_near_duplicates(frame(spark, [(*r, "en", "s", 1, "x", 1, None) for r in data]))
    assert out.columns == frame(spark, []).columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: -1 if x is None else x) == [None, *range(20), 300]
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicate_stage_takes_the_links_of_fingerprints(spark):
    import random

    # equal three-word shingles and nearly equal fingerprints, but sets of five-word shingles that are far apart
    rnd = random.Random(12)
    w = [f"v{rnd.randrange(10**6)}" for _ in range(200)]
    pool = [" ".join(x) for x in (w, *(w[:k] + ["x"] + w[k:] for k in range(0, 200, 3)))]
    spread = [" ".join(f"{x} {x}" if k % 9 == 4 else x for k, x in enumerate(w * 4)), " ".join(w * 4)]
    texts = ["a a a a a a a", "a a a a", "a a a b", "a  A a a a", *pool, *spread, "b c d e f g"]
    data = [(i, t, "en", "s", 1, "x", 1, None) for i, t in enumerate(texts)]
    fps, sets = [fingerprint(t) for t in texts], [shingles(t) for t in texts]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    assert any(near(a, b) and not similar(sets[a], sets[b]) for a in range(len(texts)) for b in range(a))
    least = {}
    for i, c in enumerate(classes(len(texts), lambda a, b: near(a, b) or similar(sets[a], sets[b]))):
        least.setdefault(c, i)
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, data)).collect())
    assert got == sorted(least.values()) and 0 in got and 1 not in got


def test_pairs_of_small_buckets_are_proposed_once(spark, monkeypatch):
    import random

    # candidates that don't hold; every bucket is small, so no round over mixed buckets is due
    monkeypatch.setattr(simhash, "_across", lambda *_: pytest.fail("small buckets proposed again"))
    rnd, texts = random.Random(6), []
    for _ in range(8):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(94)]
        texts += [w, w[:-11] + [f"u{rnd.randrange(10**6)}" for _ in range(11)], [*w[:-1], "end"]]
    data = [(i, " ".join(t), "en", "s", 1, "x", 1, None) for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, data)).collect())
    assert got == [i for i in range(24) if i % 3 < 2]


@pytest.mark.parametrize("marks", [1 << 26, 1 << 15])
def test_bitmaps_of_ids_lose_no_row(spark, monkeypatch, marks):
    from graphloom import session

    monkeypatch.setattr(session, "MARKS", marks)  # the smaller one is full
    rows_ = spark.range(-200000, 200000, 1, 4).select("id", (F.col("id") * 3).alias("x"))
    for step, first in ((1, 199999), (7, -200000), (2, -200000), (1, 200000)):
        ids = spark.range(first, 200000, step).toDF("gone").cache()
        want = set(range(first, 200000, step))
        assert {r.id for r in session.matching(rows_, F.col("id"), ids).collect()} == want
        left = session.without(rows_, F.col("id"), ids)
        assert left.columns == rows_.columns and {r.id for r in left.collect()} == set(range(-200000, 200000)) - want
    beside, few = session.marked(rows_, F.col("id"), spark.range(100).toDF("gone"))
    assert beside.where(few).count() < 0.02 * 400000


def test_bitmaps_lose_no_similar_pair():
    rnd = np.random.default_rng(11)
    held = []
    for size in (1, 4, 9, 50, 300, 1500, 6000):
        whole = rnd.integers(0, 2**63, size).astype(np.uint64)
        for lost in (0, size // 10, size // 5, size // 3):
            held += [np.unique(whole[lost:]), np.unique(np.r_[whole[lost:], rnd.integers(0, 2**63, lost).astype(np.uint64)])]
    sketch = np.array([[len(h), *simhash.bitmap(h)] for h in held], np.uint64).view(np.int64)
    linked = simhash._candidates(sketch, simhash.SIMILARITY)
    kept = lost = 0
    for x in range(len(held)):
        hit = linked(np.arange(len(held)), x)
        assert (linked(np.arange(len(held)), np.full(len(held), x)) == hit).all()
        for y in range(len(held)):
            both = len(np.intersect1d(held[x], held[y]))
            if both * 5 >= len(np.union1d(held[x], held[y])) * 4:
                assert hit[y]
                kept += 1
            else:
                lost += not hit[y]
    assert kept and lost


@pytest.mark.parametrize("starred", [4096, 10])
def test_near_duplicates_are_decided_by_shingle_sets(spark, monkeypatch, starred):
    import random

    # a centre whose copies aren't similar to one another, chains, pairs at 0.8 and just below it; small rounds and copies of sets
    monkeypatch.setattr(simhash, "NEAREST", 1)
    monkeypatch.setattr(simhash, "SERVED", 3)
    monkeypatch.setattr(simhash, "STARRED", starred)
    rnd = random.Random(8)

    def fresh(n):
        return [f"u{rnd.randrange(10**6)}" for _ in range(n)]

    texts, w = [], fresh(200)
    for _ in range(60):
        c = list(w)
        for at in rnd.sample(range(5, 195), 4):
            c[at] = fresh(1)[0]
        texts.append(c)
    texts.append(w)
    for changed in (10, 11) * 6:
        w = fresh(94)
        texts += [w, w[:-changed] + fresh(changed)]
    w = fresh(400)
    texts += [w[at : at + 150] for at in range(0, 250, 12)]
    texts += [["short"], ["Short"], ["short", "x"], [], []]
    rnd.shuffle(texts)
    data = [(i, " ".join(t), "en", "s", 1, "x", 1, None) for i, t in enumerate(texts)]
    sets = [shingles(r[1]) for r in data]
    least = {}
    for i, c in enumerate(classes(len(data), lambda a, b: similar(sets[a], sets[b]))):
        least.setdefault(c, i)
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, data)).collect())
    assert got == sorted(least.values())


def test_no_pair_of_few_shingles_is_lost(spark):
    import random

    rnd = random.Random(21)
    data = []
    for size in (5, 10, 15, 40):  # sets of size and 4/5 size shingles: exactly 0.8; one more word lost is below it
        for _ in range(400):
            w = [f"u{rnd.randrange(10**7)}" for _ in range(size + 4)]
            data += [(2 * len(data), " ".join(w)), (2 * len(data) + 1, " ".join(w[: size * 4 // 5 + 4]))]
        w = [f"u{rnd.randrange(10**7)}" for _ in range(size + 4)]
        data += [(10**6 + size, " ".join(w)), (2 * 10**6 + size, " ".join(w[: size * 4 // 5 + 3]))]
    got = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, [(*r, "en", "s", 1, "x", 1, None) for r in data])).collect()}
    assert got == {i for i, _ in data if i % 2 == 0 or i >= 10**6}


def test_similar_sets_share_the_first_shingles_of_their_prefixes():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 4, 5, 6, 9, 20, 333, 1200):
        for _ in range(40):
            x = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64))
            lost = int(rnd.integers(0, size // 5 + 1))
            y = np.unique(rnd.permutation(x)[lost:])
            a, b = simhash.prefix(x).tolist(), simhash.prefix(y).tolist()
            both = set(a) & set(b)
            assert len(both) >= simhash.shared(len(y)) >= simhash.shared(simhash.least_overlap(len(x)))
            for h in both:
                at = np.array([(len(x) << 32) + a.index(h), (len(y) << 32) + b.index(h)])
                assert simhash._placed(at, simhash.SIMILARITY)(np.array([0]), np.array([1])).all()


def test_rare_rows_still_join_every_similar_pair(spark):
    # sets of one pool of shingles, some of them in very many sets; what each node keeps must meet for all similar pairs
    rnd = np.random.default_rng(17)
    common = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    sets = {}
    for k in range(150):
        base = np.unique(np.r_[rnd.permutation(common)[: rnd.integers(0, 300)], rnd.integers(0, 2**63, rnd.integers(1, 300)).astype(np.uint64)])
        sets[3 * k] = base
        for d in (1, 2):
            lost = rnd.integers(0, len(base) // 8 + 1)
            sets[3 * k + d] = np.unique(np.r_[rnd.permutation(base)[lost:], rnd.integers(0, 2**63, lost // 2).astype(np.uint64)])
    rows = [(int(np.int64(np.uint64(h).view(np.int64))), n, (len(x) << 32) + at) for n, x in sets.items() for at, h in enumerate(simhash.prefix(x))]
    kept = defaultdict(set)
    for r in simhash.rare_common(spark.createDataFrame(rows, "key long, node long, at long")).collect():
        kept[r.node].add(r.key)
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 3 == b // 3 and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert len(pairs) > 100 and all(kept[a] & kept[b] for a, b in pairs)
    assert sum(map(len, kept.values())) < 0.8 * len(rows)


def test_counted_segments_bound_the_hamming_distance():
    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 2**64, (2, 500), dtype=np.uint64)
    by_hand = [sum(abs((a >> k & 3).bit_count() - (b >> k & 3).bit_count()) for k in range(0, 64, 2)) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    got = np.bitwise_count(simhash.counted(x) ^ simhash.counted(y))
    assert got.tolist() == by_hand and (got <= np.bitwise_count(x ^ y)).all()


# --- 9


def contaminated(text, item, k=5, least=0.8):
    a, w = WORD.findall(item.encode().lower()), WORD.findall((text or "").encode().lower())
    if not a or not w:
        return False
    g, n = min(k, len(a)), min(len(a), len(w))
    grams = lambda x: Counter(tuple(x[i : i + g]) for i in range(len(x) - g + 1))
    want = grams(a)
    for s in range(len(w) - n + 1):
        got = grams(w[s : s + n])
        both = sum((want & got).values())
        if both and both >= least * (sum(want.values()) + sum(got.values()) - both) - 1e-12:
            return True
    return False


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_decontamination(spark, block, monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "WINDOWS", 5)
    rnd = random.Random(6)
    items = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(n)) for n in (15, 25, 40, 59, 3, 5, 6)] + ["x x x x x x x x x x", "", None, " "]
    data = []
    for i in range(60):
        w = [f"z{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 120))]
        if i % 2:
            it = (rnd.choice(items[:8])).split()
            for _ in range(rnd.randrange(0, 4)):
                it[rnd.randrange(len(it))] = rnd.choice(["q", it[0], "zz"])
            at = rnd.randrange(len(w) + 1)
            w[at:at] = it[: rnd.choice([len(it), len(it), len(it) - 1, len(it) // 2])]
        data.append((i, " ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    data += [(70, None), (71, ""), (None, items[1]), (72, items[2]), (72, items[2])]
    df = frame(spark, [(*r, "en", "s", 1, "x", 1, None) for r in data])
    bench = spark.createDataFrame([*enumerate(items), (None, items[0])], "item_id long, text string")
    want = Counter((i, k) for i, t in data for k, it in enumerate(items) if it and contaminated(t, it))
    got = decontaminate.contamination(df, bench)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in data if not any(it and contaminated(t, it) for it in items))
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(data)


def test_multi_index_gives_all_items_within_the_radius():
    rnd = np.random.default_rng(8)
    shelf = decontaminate.Shelf(24)
    shelf.fps, shelf.items = rnd.integers(0, 2**64, 500, dtype=np.uint64), list(range(500))
    shelf.close()
    for fp in shelf.fps[:40] ^ rnd.integers(0, 2**64, 40, dtype=np.uint64) & rnd.integers(0, 2**64, 40, dtype=np.uint64) & rnd.integers(0, 2**64, 40, dtype=np.uint64):
        assert shelf.near(np.array([fp]))[1].tolist() == [k for k, x in enumerate(shelf.fps.tolist()) if (x ^ int(fp)).bit_count() <= 24]
    s = rnd.integers(0, 2**64, 300, dtype=np.uint64)
    starts = np.array([0, 1, 2, 40, 41, 200, 290])
    for size in (1, 7, 10):
        want = [sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in s[a : a + size].tolist()) > size) for a in starts.tolist()]
        assert decontaminate.window_fingerprints(s, starts, size).tolist() == want


# --- 10


def without_lines(data):
    first, docs = {}, sorted({(i, t) for i, t in data if i is not None and t is not None}, key=lambda x: (x[0], x[1]))
    seen = defaultdict(list)
    for i, t in docs:
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            seen[tuple(ls[p : p + 3])].append((i, t, p))
    del first
    return seen


def test_line_dedup(spark):
    data = [r for r in rows() if r[0] != 8]  # one text for each id, so that the order of occurrences is that of ids
    seen = without_lines([r[:2] for r in data])
    want = Counter()
    for r in data:
        ls = (r[1] or "").split("\n")
        gone = {p + d for p in range(len(ls) - 2) if r[0] is not None and r[1] is not None and min((i, q) for i, _, q in seen[tuple(ls[p : p + 3])]) < (r[0], p) for d in range(3)}
        want[r[0], None if r[1] is None else "\n".join(x for p, x in enumerate(ls) if p not in gone), *r[2:], 0 if r[1] is None else len(ls), len(gone)] += 1
    got = lines.deduplicate_lines(frame(spark, data), n_lines="n", n_removed="gone")
    assert table(got) == want
    assert sum(k[-1] for k in want) > 5
    assert lines.deduplicate_lines(frame(spark)).count() == len(rows())
    assert lines.deduplicate_lines(frame(spark, [])).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = lines.deduplicate_lines(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LogicalRDD", ""))


# --- hashes


def test_gram_hashes_tell_sequences_apart():
    h = np.arange(1, 400, dtype=np.uint64) % np.uint64(11)
    for n in (1, 2, 3, 5, 25, 50):
        g = common.gram_hashes(h, n)
        assert len(g) == len(h) - n + 1
        seen = {}
        for i, x in enumerate(g.tolist()):
            assert seen.setdefault(x, tuple(h[i : i + n].tolist())) == tuple(h[i : i + n].tolist())
        assert len(seen) == len({tuple(h[i : i + n].tolist()) for i in range(len(g))})
        assert common.sliding(np.minimum, h, n).tolist() == [int(h[i : i + n].min()) for i in range(len(h) - n + 1)]


def test_rank_files_are_read():
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        token, rank = next(f).split()
    assert ranks[base64.b64decode(token)] == int(rank)
    assert SCHEMA.startswith("doc_id long")


def test_a_worker_gives_freed_memory_back():
    import pyarrow as pa

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    def batches():
        for _ in range(3):
            yield pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["x"])

    before = held()
    for b in common.some(batches()):
        assert b.num_rows == 1
        junk = [np.full(12_000, k) for k in range(2000)]  # 96 kB each, below malloc's threshold for maps: 190 MB
        last = junk[-1]  # keeps the top of the heap, so that malloc alone returns nothing
        del junk
    assert held() - before < 60 and len(last) == 12_000
