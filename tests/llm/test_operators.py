"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import audio, decontaminate, langid, nearcopies, pieces, pii, queries, repeats, sharding, simhash, urls, warc

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(120, 1)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, NEAR), (4, None), (5, ""), (None, prose(90, 2)), (6, prose(90, 2)), (7, "qq"), (8, " \n\t "),
    (9, prose(6000, 3)), (10, "😀 ünï 𝔘 ▁ é" * 40), (11, "a" * 3000), (12, prose(50, 4) + " a.b@x.org, +1 (017) 555-7713, 4111 1111 1111 1111, 10.0.0.255"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, _key string, media string, n_bytes long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 7 else "en", None, None, 0.5, "x", "k", "m", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    html = "<p>" + "long page " * 20
    pages = [(1, "http://A.Example.org/en/1x?q", html), (2, "https://b.example.org/es/2#t", html), (2, None, html), (3, "nothing", None), (4, "http://x.com/fr/1", ""), (5, "http://y.com/de/2", "short"), (6, "http://y.com/de/3", "short"), (None, "http://z.net", html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(1, " ".join(BASE.split()[20:60])), (2, prose(30, 77)), (3, None), (4, ""), (5, "Qq!")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return root


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_urls(spark, sf):
    got = {(r["page_id"], r["path"]): r for r in rows(urls.op1_urls(spark, sf))}
    assert len(got) == 8
    assert (got[1, "/en/1x"]["host"], got[1, "/en/1x"]["rule"], got[1, "/en/1x"]["verdict"]) == ("a.example.org", "example.org/en/1", "block")
    assert (got[2, "/es/2"]["rule"], got[4, "/fr/1"]["rule"], got[5, "/de/2"]["verdict"]) == ("example.org/es/", "com/fr/", "block")
    assert (got[2, ""]["host"], got[2, ""]["rule"], got[3, ""]["host"]) == ("", None, "")


def test_url_templates_learn(spark):
    pages = [(i, f"http://h.net/good/{i}") for i in range(40)] + [(100 + i, f"http://h.net/bad/{i}.html") for i in range(40)]
    pages += [(200 + i, f"http://h.net/{w}/x") for i, w in enumerate(WORDS[:30])]
    labels = [(i, i < 100) for i, _ in pages if i % 2]
    got = {r["id"]: r for r in rows(urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "id long, good boolean")))}
    assert got[2]["template"] == "/good/#" and got[2]["verdict"] == "allow"
    assert got[102]["template"] == "/bad/#.html" and got[102]["verdict"] == "block"


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.JUMP_MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf):
    keys = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    for n in (1, 2, 40, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    got = rows(sharding.op2_sharding(spark, sf))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        key = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little"), 42)
        assert r["shard"] == jump(key, 40) and r["grown_shard"] in (r["shard"], 40)
    many = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("shard"))
    slots = sharding.number_slots(many, rows_a_bucket=50).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in slots if r["shard"] == s) == list(range(1000))


def test_language(spark, sf):
    got = rows(langid.op3_langid(spark, sf))
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and (r["doc_id"] not in (4, 5, 8) or (r["lang_pred"], r["score"]) == ("und", 0))


def test_language_sample_takes_copies_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda texts, langs: (texts, langs))
    hot = next(t for t in (prose(20, s) for s in range(99)) if langid.fit(spark.createDataFrame([(t, "en")], "text string, lang string"), 1)[0])
    data = [(hot, "en")] * 3000 + [(prose(20, i), x) for x in ("en", "de") for i in range(200, 260)]
    texts, langs = langid.fit(spark.createDataFrame(data, "text string, lang string"), 40)
    assert texts.count(hot) <= 1 and 20 <= Counter(langs)["en"] <= 60 and 20 <= Counter(langs)["de"] <= 60


def test_language_switches(spark):
    r = random.Random(2)
    vocabulary = {"aa": ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(60)], "zz": ["".join(r.choice("uvwxyz") for _ in range(5)) for _ in range(60)]}
    texts = [(" ".join(r.choice(vocabulary[y]) for _ in range(60)), y) for y in ("aa", "zz") * 30]
    model = langid.train([t for t, _ in texts], [y for _, y in texts])
    mixed = " ".join(r.choice(vocabulary["aa"]) for _ in range(10)) + " " + " ".join(r.choice(vocabulary["zz"]) for _ in range(10))
    assert [x for _, _, x, _ in model.words(mixed)] == ["aa"] * 10 + ["zz"] * 10
    df = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert langid.label_words(df, model).count() == 20


def test_forward_backward_is_exact():
    g = np.random.default_rng(0)
    model = langid.Crf(list("abc"), None, g.normal(size=(3, 3)))
    counts = np.array([0, 1, 70, 32, 200])
    scores = g.normal(size=(counts.sum(), 3)).astype(np.float32)
    found, at, move = model.posteriors(scores, counts), 0, np.exp(model.moves)
    for n in counts:
        e = np.exp(scores[at : at + n].astype(float))
        a, b, v = np.zeros((n, 3)), np.ones((n, 3)), np.ones(3) / 3
        for t in range(n):
            v = (v @ move) * e[t]
            v = a[t] = v / v.sum()
        for t in range(n - 2, -1, -1):
            b[t] = move @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        both = a * b
        assert np.allclose(found[at : at + n], both / both.sum(1, keepdims=True), atol=1e-4)
        at += n


def test_warc(spark, sf):
    got = rows(warc.op4_warc(spark, sf))
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 1)])
    html = ("<p>" + "long page " * 20).encode()
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 2)} == {hashlib.sha256(html).hexdigest()}
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 2)} == {len(html)}


def test_audio(spark, sf):
    by_text = dict(TEXTS)
    for r in rows(audio.op5_audio(spark, sf)):
        raw = (by_text[r["doc_id"]] or "").encode()
        data = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = audio.wav(data)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(raw), len(data), len(media), zlib.crc32(data[-16:]))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(media).hexdigest())


def test_audio_signal(spark):
    g = np.random.default_rng(1)
    x = g.integers(0, 256, 900).astype(np.uint8)
    n = audio.resampled_size(900)
    up = np.zeros(900 * audio.UP)
    up[:: audio.UP] = (x.astype(float) - 128) / 128
    want = np.convolve(up, audio.phases()[:, ::-1].T.reshape(-1))[:: audio.DOWN][:n]
    assert np.allclose(np.r_[audio.resample(x, 0, 100), audio.resample(x, 100, n)], want, atol=1e-5)
    loud = np.full(20000, 128) + np.where(np.arange(20000) // 5000 == 1, 90, 1) * np.sin(np.arange(20000))
    payload = loud.astype(np.uint8).tobytes()
    (span,) = audio.energy_segments(payload)
    assert abs(span[0] - 5000 / 8000) < 0.06 and abs(span[1] - 10000 / 8000) < 0.06
    df = spark.createDataFrame([(1, audio.wav(payload)), (2, None), (3, b"")], "doc_id long, media binary")
    table = audio.tensors(df).toArrow()
    assert audio.tensor_array(table["tensor"]).to_numpy_ndarray().shape == (table.num_rows, audio.CLIP, audio.MELS)
    assert {r["doc_id"]: r["frames"] for r in rows(audio.features(df))}[2] == 0


def fingerprint(text, width=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def brute_components(prints, radius):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in nodes}


def test_simhash(spark, sf):
    roots = brute_components([fingerprint(t) for _, t in TEXTS], 4)
    least = {}
    for i, t in TEXTS:
        if i is not None:
            least[roots[fingerprint(t)]] = min(i, least.get(roots[fingerprint(t)], 1 << 60))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows(simhash.op6_simhash(spark, sf)))
    assert got == Counter((i, f"{fingerprint(t):016x}", least[roots[fingerprint(t)]]) for i, t in TEXTS)


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
@pytest.mark.parametrize("block", [8, 2048])
def test_pigeonring_finds_all_links(spark, radius, block):
    r = random.Random(radius)
    prints = {r.getrandbits(64) for _ in range(200)}
    for center in list(prints)[:6]:  # crowds that share keys
        for _ in range(60):
            x = center
            for _ in range(r.randint(0, 8)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, block))
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in rows(found)}
    want = brute_components(prints, radius)
    groups = lambda m: {frozenset(x for x in m if m[x] == y) for y in set(m.values())}
    assert groups({f: got.get(f, f) for f in prints}) == groups(want)


def test_near_copies_leave_one(spark, docs):
    kept = rows(simhash.drop_near_copies(docs))
    assert Counter(r["doc_id"] for r in kept)[1] == 1 and not {2, 3, 5, 8} & {r["doc_id"] for r in kept} and set(kept[0]) == set(docs.columns)
    assert {4, 6, 7, 9, 10, 11, 12} <= {r["doc_id"] for r in kept}


def test_decontamination(spark, sf, docs):
    got = {(r["doc_id"], r["item_id"]): r for r in rows(decontaminate.op7_decontaminate(spark, sf))}
    assert {(1, 1), (2, 1)} <= set(got) and got[1, 1]["similarity"] == 1 and got[1, 1]["start_word"] == 20
    assert {k for k in got if k[1] == 5} == {(7, 5)} and not {k for k in got if k[1] in (2, 3, 4)}
    held = " ".join([*BASE.split()[:70], "new", *BASE.split()[71:]])
    df = spark.createDataFrame([(1, "start " + held.upper() + "! end"), (2, prose(120, 9))], "doc_id long, text string")
    item = spark.createDataFrame([(i, BASE) for i in range(3)], "item_id long, text string")
    found = rows(decontaminate.contaminated(df, item, index_bytes=1))
    assert {(r["id"], r["item"]) for r in found} == {(1, 0), (1, 1), (1, 2)} and all(0.8 <= r["similarity"] < 1 for r in found)
    assert [r["doc_id"] for r in rows(decontaminate.drop_contaminated(df, item))] == [2]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]


def brute_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0]))


def test_pii(spark, sf):
    by_text = dict(TEXTS)
    for r in rows(pii.op8_pii(spark, sf)):
        want = brute_spans(by_text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want
    r = random.Random(3)
    odd = ["".join(r.choice("a@.1234567890 -+()_é😀x255") for _ in range(80)) for _ in range(300)] + ["1" * 5000, "a." * 5000, "@a.b" * 3000, "1 " * 9000, "+1" + "(" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in rows(pii.find_pii(df, ["doc_id"]).select("doc_id", pii.joined(F.concat(*pii.KINDS)).alias("s"))):
        assert r["s"] == brute_spans(odd[r["doc_id"]])


def test_pii_terms(spark):
    texts = [(i, f"word{i} other filler{i}") for i in range(200)] + [(1000 + i, f"case{i} zorblax a.b@x.org item{i}") for i in range(4)] + [(2000, "the zorblax agent"), (3000, None)]
    got = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(spark.createDataFrame([(*x, 0) for x in texts], "doc_id long, text string, n_chars long")))}
    assert got[2000] == "the  agent" and got[1001] == "case1  [EMAIL] item1" and got[3] == texts[3][1] and got[3000] is None and len(got) == len(texts)


def brute_repeats(docs, n):
    seen = Counter(b[i : i + n] for b in docs for i in range(len(b) - n + 1))
    for b in docs:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        yield len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_repeats(spark, sf):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.op9_repeats(spark, sf)))
    assert got == Counter((i, *x) for (i, _), x in zip(TEXTS, brute_repeats([(t or "").encode() for _, t in TEXTS], 400), strict=True))


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_repeats_short(spark, block):
    r = random.Random(8)
    passages = [prose(8, s).encode() for s in range(4)]
    texts = [b" ".join([prose(r.randint(0, 9), 100 + i).encode(), r.choice(passages), b"ab" * r.randint(0, 40)]).decode() for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.without_repeats(df, length=24, gram=7, block=block))}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 24)))


def test_interval_expansion():
    r = random.Random(1)
    for _ in range(150):
        alphabet, n = r.choice([b"ab", b"abc", bytes(range(256))]), r.choice([1, 2, 8, 20])
        base = bytes(r.choice(alphabet) for _ in range(60))
        parts = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 40))) + base[r.randint(0, 40) :] for _ in range(r.randint(1, 6))]
        seen = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        want = [x for p in parts for x in [i + n <= len(p) and seen[p[i : i + n]] > 1 for i in range(len(p))] + [False]]
        assert repeats.repeated_starts(parts, n).tolist() == want


def brute_pieces(held, text, key):
    """The ids of a text by an agenda that is searched anew for each candidate."""
    base, out = held.base_of(key), []
    units = [u for k, part in enumerate((" " + text).split("▁")) for u in ([""] if k else []) + re.findall("▁*[^▁]+|▁+", part.replace(" ", "▁"))]
    for number, unit in enumerate(units):
        pieces_, skipped, fresh = [(c, i) for i, c in enumerate(unit or "▁")], set(), 10**6
        for k in range(10**6):
            open_ = [(held.order[a + b], i) for i, ((a, x), (b, y)) in enumerate(zip(pieces_, pieces_[1:])) if unit and a + b in held.order and (x, y) not in skipped]
            if not open_:
                break
            _, i = min(open_)
            if held.skipped(base, np.array([number]), k)[0]:
                skipped.add((pieces_[i][1], pieces_[i + 1][1]))
            else:
                pieces_[i : i + 2] = [(pieces_[i][0] + pieces_[i + 1][0], fresh + k)]
        for p, _ in pieces_:
            out += [held.ids[p]] if unit and p in held.ids else [held.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
    return out


def test_pieces(spark, sf, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, dropped = pieces.Pieces(pieces.MODEL, 0.0), pieces.Pieces(pieces.MODEL, 0.3, 1)
    for _, t in TEXTS:
        if t is not None:
            assert "▁" in t or plain.encode(t).tolist() == library.encode(t)
            assert plain.decode(plain.encode(t)) == t and dropped.decode(dropped.encode(t, 3)) == t
    assert pieces.Pieces(pieces.MODEL, 1.0).encode("ab").tolist() == [plain.ids[c] for c in "▁ab"]
    assert all(r["lossless"] for r in rows(pieces.op10_pieces(spark, sf)))
    back = rows(pieces.decode(pieces.encode(docs)))
    assert Counter((r["doc_id"], r["decoded"]) for r in back) == Counter(TEXTS)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 0.97])
def test_pieces_against_brute_force(monkeypatch, dropout):
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    monkeypatch.setattr(pieces, "REMEMBER", 120)
    held = pieces.Pieces(pieces.MODEL, dropout)
    odd = ["x\u0001y ▁▁ z\ud800 漢字かな 😀😀 é", "   ", "▁", "a  b   c    ", "segmentation " * 30, "internationalisation" * 4, "\n\t\r", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3]
    texts = odd + [prose(40, s) for s in range(6)] + ["The quick brown fox jumps over lazy dogs, and thousands of others repeated it everywhere. " * 3]
    flat, sizes = held.encode_many([*texts, None, ""], [*range(len(texts)), 0, 0])
    want = [brute_pieces(held, t, i) for i, t in enumerate(texts)]
    assert sizes.tolist() == [*map(len, want), 0, 0] and flat.tolist() == [x for w in want for x in w]
    assert [held.decode(held.encode(t, 5)) for t in texts] == texts


def test_pieces_vary_by_occurrence(spark):
    held = pieces.Pieces(pieces.MODEL, 0.3)
    df = spark.createDataFrame([(i, f"text{i}" + " segmentation" * 50) for i in (1, 2, 2)], "doc_id long, text string")
    got = {}
    for r in rows(pieces.encode(df)):
        assert got.setdefault(r["doc_id"], r["ids"]) == r["ids"]
    ways = []
    for ids in got.values():
        texts = [held.raw[i] for i in ids]
        ways.append(tuple(b"|".join(texts).split(b"| ")[2:]))
    assert len(set(ways[0])) > 5 and ways[0] != ways[1]
    usual = pieces.Pieces(pieces.MODEL)
    drawn = usual.skipped(np.full(100_000, usual.base_of(3)), np.arange(100_000), 2)
    assert abs(drawn.mean() - 0.1) < 0.005


def edited(text, edits, seed):
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), edits):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def jaccard(x, y, width=5):
    a, b = ({tuple(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_near_copies_by_similarity(spark):
    """Pairs from 0.6 to 1, and a crowd larger than a block: what is dropped is what exact similarity links."""
    texts = [t for s in range(150) for t in (prose(300, 500 + s), edited(prose(300, 500 + s), 3 + s % 13, s))]
    pairs = [jaccard(texts[i], texts[i + 1]) for i in range(0, 300, 2)]
    crowd = [edited(prose(300, 900), 2, s) for s in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + crowd)], "doc_id long, text string")
    kept = {r["doc_id"] for r in rows(simhash.drop_near_copies(df))}
    near = [2 * k + 1 for k, x in enumerate(pairs) if x >= 0.8]
    assert len(near) > 50 and min(pairs) < 0.75
    assert not kept & set(near) and {2 * k + 1 for k, x in enumerate(pairs) if x < 0.8} <= kept and set(range(0, 300, 2)) <= kept
    assert {i for i in kept if i >= 300} == {300}


@pytest.mark.parametrize("texts", [
    [f"case{i} zorblax a.b@x.org item{i}" for i in range(4)] + ["case9 zorblax a.b@x.org item9"] * 300,  # one context has 300 copies
    [f"own{i} text{i} of each one{i} here{i} first{i}: write to the zorblax desk at a.b@x.org or come along with us all" for i in range(50)],  # one passage in all
], ids=["copied", "shared"])
def test_pii_counts_documents(spark, texts):
    data = [(i, f"word{i} write to the desk or come along with us all") for i in range(1000)] + [(2000 + i, t) for i, t in enumerate(texts)] + [(9000, "the zorblax agent")]
    got = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got[9000] == "the  agent" and "zorblax" not in " ".join(got.values()) and got[5] == data[5][1] and len(got) == len(data)


def brute_audio(payload):
    """Log-mel bands, and the energy segments, straight from their definitions."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(audio.UP, audio.DOWN)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    y = np.convolve(up, h / h.sum() * audio.UP)[:: audio.DOWN]
    y, size = np.r_[y, np.zeros(audio.WINDOW)], -(-len(x) * audio.UP // audio.DOWN)  # the filter rings on after the end
    rate = audio.RATE * audio.UP / audio.DOWN
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    bands, levels = [], []
    for at in range(0, max(1, size - audio.WINDOW + 1), audio.HOP):
        frame = y[at : at + audio.WINDOW] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / (audio.WINDOW - 1)))
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(audio.WINDOW) / audio.WINDOW))) ** 2 for k in range(audio.WINDOW // 2 + 1)]
        weigh = lambda f, a, b, c: max(0, min((f - a) / (b - a), (c - f) / (c - b)))
        bands.append([np.log(sum(p * weigh(k * rate / audio.WINDOW, *edges[m : m + 3]) for k, p in enumerate(power)) + audio.FLOOR) for m in range(audio.MELS)])
        levels.append(10 * np.log10(np.mean(frame**2) + audio.FLOOR))
    on, spans, mean = False, [], np.mean(levels)
    step, size = audio.HOP / rate, audio.WINDOW / rate
    for i, v in enumerate(levels):
        if not on and v >= mean + audio.OPEN_DB:
            on, first = True, i
        elif on and v < mean + audio.CLOSE_DB:
            on = False
            spans.append((first * step, (i - 1) * step + size))
    return np.array(bands), [*spans, *([(first * step, (len(levels) - 1) * step + size)] if on else [])]


@pytest.mark.parametrize("size", [1, 192, 341, 342, 5000, 12000])
def test_audio_against_brute_force(size, monkeypatch):
    monkeypatch.setattr(audio, "PIECE", 64)  # a clip a piece
    g = np.random.default_rng(size)
    payload = (128 + g.normal(size=size) * np.repeat(g.integers(1, 40, -(-size // 900)), 900)[:size]).clip(0, 255).astype(np.uint8).tobytes()
    bands, spans = brute_audio(payload)
    got = np.concatenate([t.reshape(-1, audio.MELS) for t, _ in audio.clips(payload)])
    assert np.allclose(got[: len(bands)], bands, atol=0.0101) and (got[len(bands) :] == np.float32(np.round(np.float32(np.log(audio.FLOOR)), 2))).all()
    assert len(got) == -(-len(bands) // audio.CLIP) * audio.CLIP == audio.CLIP * -(-audio.frames_of(size) // audio.CLIP)
    assert np.allclose(np.array(audio.energy_segments(payload)).reshape(-1, 2), np.array(spans).reshape(-1, 2))


def test_audio_stores_tensors(spark, sf, monkeypatch):
    tables = []
    monkeypatch.setattr(audio, "scratch_path", lambda spark, label, made=audio.scratch_path: tables.append((label, made(spark, label))) or tables[-1][1])
    got = rows(audio.op5_audio(spark, sf))
    (path,) = [p for label, p in tables if label == "tensors"]
    stored = spark.read.parquet(path).toArrow()
    payloads = {i: (t or "").encode().ljust(max(192, -(-len((t or "").encode()) // 192) * 192)) for i, t in TEXTS}

    def feature(payload):
        found = [(c + first, audio.span(c + first, len(payload)), t) for ts, first in audio.clips(payload) for c, t in enumerate(ts)]
        crcs = [zlib.crc32(t.astype("<f4").tobytes(), zlib.crc32(struct.pack("<dd", *s))) for _, s, t in found]
        spans = ",".join(f"{a:.4f}-{b:.4f}" for a, b in audio.energy_segments(payload))
        return f"frames={audio.frames_of(len(payload))};clips={len(found)};crc={zlib.crc32(struct.pack(f'<{len(crcs)}I', *crcs))};segments={spans}"

    assert Counter((r["doc_id"], r["feature"]) for r in got) == Counter((i, feature(payloads[i])) for i, _ in TEXTS)
    assert audio.tensor_array(stored["tensor"]).to_numpy_ndarray().shape == (stored.num_rows, audio.CLIP, audio.MELS)
    assert {"start_s", "end_s", "clip"} <= set(stored.column_names)
    noise = np.random.default_rng(4).integers(0, 256, 900_000).astype(np.uint8).tobytes()  # more than one piece
    df = spark.createDataFrame([(1, audio.wav(noise)), (2, None)], "doc_id long, media binary")
    (r,) = rows(audio.stored_digests(audio.store_tensors(df, "doc_id")))
    assert f"clips={r['clips']};crc={r['tensor_crc32']};" in feature(noise)


def test_repeats_hashed_strings_do_not_collide(spark):
    signs = [i.bit_count() % 2 for i in range(2048)]  # Thue-Morse: sums modulo 2**64 agree with the complement's, whatever the base
    texts = ["".join("ab"[x] for x in signs), "".join("ba"[x] for x in signs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in rows(repeats.without_repeats(df, length=2048, gram=7, block=1))] == [0, 0]


def brute_roots(texts, width=5, similarity=0.8):
    grams = [{tuple(t.split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= similarity * len(grams[i] | grams[j]) - 1e-9:
                root[find(i)] = find(j)
    return {i for i in range(len(texts)) if find(i) == i}, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [10, 1024])
def test_near_copies_of_large_families(spark, block):
    """Edited texts of which only some are like the centre, in chains too: components as by brute force over all pairs."""
    texts = [edited(prose(200, 70 + f), 1 + s % 9, 100 * f + s) for f in range(3) for s in range(60)]
    for s in range(12):  # a chain, each like the one before
        texts.append(edited(texts[-1] if s else prose(200, 80), 4, 7000 + s))
    texts += [prose(100, 9000 + s) for s in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in rows(nearcopies.near_copy_roots(df, block=block))}
    names = [hashlib.md5(t.encode()).digest() for t in texts]
    _, want = brute_roots(texts)
    groups = lambda ids: {frozenset(i for i, x in enumerate(ids) if x == y) for y in set(ids)}
    assert len(groups(want)) > 25 and groups([roots.get(n, n) for n in names]) == groups(want)


def brute_contamination(text, item, width=5):
    """(similarity, first word) of a document's best window, by bags of shingles."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    own, wanted = words(text), words(item)
    if not wanted:
        return 0, None
    w = min(width, len(wanted))
    grams = lambda ws: [tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)]
    bag, mine = Counter(grams(wanted)), grams(own)
    n, best = sum(bag.values()), (0, None)
    for i in range(len(mine) - n + 1):
        same = sum((Counter(mine[i : i + n]) & bag).values())
        best = max(best, (same / (2 * n - same), i), key=lambda x: x[0])
    return best


def test_decontamination_against_brute_force(spark):
    """Held items with edits, from similarity 0.6 to 1: all found with a radius of 64 bits, and 0.95 or more with the usual one."""
    items = [(i, prose(n, 300 + i)) for i, n in enumerate((3, 5, 12, 40, 40, 80, 80, 120))] + [(8, "again " * 30), (9, " "), (10, None)]
    texts = []
    for k in range(400):
        item = items[3 + k % 5][1]
        texts.append(prose(15, 5000 + k) + " " + edited(item, k // 5 % 3 + len(item.split()) // 60, k) + " " + prose(11, 6000 + k))
    texts += ["again " * 34, items[0][1], items[1][1].upper(), "", prose(300, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for j, item in items:
            alike, start = brute_contamination(t, item or "")
            if alike >= 0.8:
                want[i, j] = (round(alike, 9), start)
    exact = {(r["id"], r["item"]): (round(r["similarity"], 9), r["start_word"]) for r in rows(decontaminate.contaminated(df, bench, radius=64))}
    usual = {(r["id"], r["item"]): (round(r["similarity"], 9), r["start_word"]) for r in rows(decontaminate.contaminated(df, bench))}
    assert exact == want and len(want) > 150 and sum(s < 0.9 for s, _ in want.values()) > 50
    assert set(usual) <= set(want) and len(usual) >= 0.95 * len(want)


def test_decontamination_in_runs_of_windows(spark, monkeypatch):
    """A text that is all benchmark passages has more windows than a run: cut runs find the same."""
    item = prose(60, 41)
    df = spark.createDataFrame([(1, " ".join([item] * 40)), (2, prose(500, 42) + " " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, " ".join(item.split()[:30]))], "item_id long, text string")
    assert len(decontaminate.contaminated(df, bench).collect()) == 4
    held = decontaminate.Benchmark([(r["item_id"], r["text"]) for r in bench.collect()], 5, 0.8, 17)
    texts = [r["text"] for r in df.collect()]
    whole = sorted(held.scan(texts))
    found = decontaminate.runs(np.arange(100), 5, 7)
    assert np.concatenate(found).tolist() == list(range(100)) and max(map(len, found)) == 7
    monkeypatch.setattr(decontaminate.runs, "__defaults__", (16,))
    assert sorted(held.scan(texts)) == whole and len(whole) == 4


def test_decontamination_index_prunes():
    g = np.random.default_rng(3)
    group = decontaminate.Sized(prints=[int(x) for x in g.integers(0, 1 << 64, 500, np.uint64)])
    group.index(decontaminate.RADIUS)
    windows = g.integers(0, 1 << 64, 300, np.uint64)
    held = [np.unpackbits(t[group.block(windows, b).astype(int)], axis=1, count=500) for b, t in enumerate(group.tables)]
    assert 0.1 < np.bitwise_or.reduce(held).mean() < 0.25
    window, item = group.near(np.r_[windows, group.fps ^ np.uint64(0b1011)], decontaminate.RADIUS)
    far = np.bitwise_count(np.r_[windows, group.fps ^ np.uint64(0b1011)][:, None] ^ group.fps[None, :]) <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*map(list, np.nonzero(far))))


def test_language_of_held_out_documents(spark):
    """Texts that training never saw: their label is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).dropDuplicates(["text"])
    held = docs.withColumn("out", langid.held_out(F.col("doc_id")))
    model = langid.fit(held.filter("not out"))
    found = langid.predict(held.filter("out and lang is not null and text is not null"), model)
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert total > 100 and right / total > 0.97


def test_language_learns_every_label_and_reads_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda texts, langs: (texts, langs))
    df = spark.createDataFrame([(prose(5, i), f"l{i % 300}") for i in range(600)] + [("x " * 700_000, "l0")], "text string, lang string")
    texts, langs = langid.fit(df, 40)
    assert len(set(langs)) == 300 and max(map(len, texts)) < 1000  # the long text isn't drawn
    monkeypatch.undo()
    model = langid.train(["aab bba " * 30, "xyz zyx " * 30], ["a", "x"])
    text = prose(300, 4) + " é " + "xyz zyx " * 50
    whole = model.documents([text])
    monkeypatch.setattr(langid, "PIECE", 100)
    assert np.allclose(whole[1], model.documents([text])[1]) and whole[0] == model.documents([text])[0]


def test_slots_with_clashing_columns(spark):
    df = spark.createDataFrame([(i % 5, i, 1, 2, 3, 4, None if i % 7 == 0 else i % 3) for i in range(60)], "_n int, _bucket int, _first int, n int, bucket int, `from` int, shard int")
    got = sharding.number_slots(df, rows_a_bucket=3)
    assert got.columns == [*df.columns, "slot"]
    for s in (None, 0, 1, 2):
        mine = sorted(r["slot"] for r in got.collect() if r["shard"] == s)
        assert mine == list(range(len(mine))) and mine


def brute_templates(paths):
    """path rows (host, path, good, bad) -> template, level by level over plain lists."""
    rate = lambda bad, n, to: (bad + urls.SMOOTHING * to) / (n + urls.SMOOTHING)
    parts = {(h, p): [] if p == "" else re.sub("^/", "", p).split("/", urls.DEPTH - 1) for h, p, _, _ in paths}
    made = {(h, p): "" for h, p, _, _ in paths}
    for level in range(urls.DEPTH):
        nodes = {}
        for h, p, good, bad in paths:
            if len(parts[h, p]) > level:
                part = parts[h, p][level]
                branch = nodes.setdefault((h, made[h, p]), {}).setdefault(re.sub("[0-9]+", "#", part), [set(), 0, 0])
                branch[0].add(part)
                branch[1] += good
                branch[2] += bad
        names = {}
        for (h, t), branches in nodes.items():
            all_good, all_bad = (sum(b[i] for b in branches.values()) for i in (1, 2))
            for shape, (values, good, bad) in branches.items():
                n, other = good + bad, all_good + all_bad - good - bad
                p = rate(all_bad, all_good + all_bad, 0.5)
                z = abs(rate(bad, n, p) - rate(all_bad - bad, other, p)) / (p * (1 - p) * (1 / (n + urls.SMOOTHING) + 1 / (other + urls.SMOOTHING))) ** 0.5
                names[h, t, shape] = "*" if len(branches) >= urls.MANY and z < urls.Z else shape if len(values) >= urls.VARIED else None
        for h, p, _, _ in paths:
            if len(parts[h, p]) > level:
                part = parts[h, p][level]
                name = names[h, made[h, p], re.sub("[0-9]+", "#", part)]
                plain = lambda x: re.sub(r"([*\\])", r"\\\1", x)
                made[h, p] += "/" + ("*" if name == "*" else plain(part if name is None else name))
    return made


@pytest.mark.parametrize("hot", [2, 5000])
def test_url_templates_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT_ROWS", hot)
    r = random.Random(4)
    paths = {}
    for i in range(1500):
        h = r.choice(["a.net", "a.net", "b.org", "c.com"])
        kind = r.choice(["/item/%d", "/user/%d/posts/%d", "/tag/" + r.choice(WORDS), "/" + r.choice(WORDS) + "/x", "", "/", "//", "/a*b/%d", "/1/2/3/4/5/6/7/8/9/%d"])
        paths[h, kind % tuple(r.randint(1, 60) for _ in range(kind.count("%d")))] = (1, *r.choice([(1, 0), (0, 1), (0, 0), (2, 1)]))
    data = [(h, p, *v) for (h, p), v in paths.items()]
    got = {(x["host"], x["path"]): x["template"] for x in rows(urls.templates(spark.createDataFrame(data, "host string, path string, n long, good long, bad long")))}
    assert got == brute_templates([(h, p, g, b) for h, p, _, g, b in data]) and any("*" in t for t in got.values()) and any("#" in t for t in got.values())


def test_warc_rotates_archives(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    data = [(i, f"http://h/{i}", ("page %d " % (i % 5)) * 40) for i in range(60)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2)
    folder = warc.local_uri(warc.scratch_path(spark, "rotated"))
    files = warc.write_warc(df, "page_id", "url", "html", folder)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows(warc.read_archives(files, folder))}
    assert files.count() > 5 and got == {i: ("response", None) if i < 5 else ("revisit", i % 5) for i in range(60)}
    with pytest.raises(TypeError):
        warc.write_warc(df.withColumn("page_id", F.col("url")), "page_id", "url", "html", folder)


def test_session_keeps_its_batch_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    simhash.links(spark.createDataFrame([(1,), (2,)], "fp long"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_anchors_of_long_texts(monkeypatch):
    """A text anchored in pieces has the anchors of the whole: every string's is the same."""
    text = (prose(300, 2) + "ab" * 90 + prose(100, 2)).encode()
    each = lambda: np.concatenate([np.repeat(h, c) for h, _, c in repeats.anchors(text, 24, 7)])
    whole = each()
    monkeypatch.setattr(repeats, "PIECE", 90)
    assert (each() == whole).all() and len(whole) == len(text) - 23


def test_repeats_leave_no_table(spark):
    texts = [prose(60, 1) + " " + prose(40, s) for s in range(5)] + ["ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.without_repeats(df, length=24, gram=7))}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 24)))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loomtext_texts")]


def test_pii_generalises_terms(spark):
    """A disclosing term with digits becomes its general form where that is common; one whose general form discloses too is removed."""
    texts = [f"note room{i} is free word{i}" for i in range(300)] + [f"ask{i} room417 or QZ-77x a.b@x.org item{i}" for i in range(6)]
    data = [(i, t) for i, t in enumerate(texts)] + [(900, "see room417 and 77x there"), (901, None)]
    got = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got[900] == "see room### and  there" and got[301] == "ask1 room### or QZ- [EMAIL] item1" and got[5] == texts[5] and got[901] is None


def brute_terms(texts, support, disclosure):
    """Disclosing terms and their ratio from the definition, over lists."""
    words = lambda t: re.findall(r"[^\W_]+", t)
    general = lambda w: re.sub("[0-9]", "#", w)
    forms = lambda ws: {f for w in ws for f in (w.lower(), general(w.lower()))}
    held, both = Counter(), Counter()
    for t in texts:
        spans = [(m.start(), m.end(), m[0].lower()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])]
        held.update({e for *_, e in spans})
        both.update({(f, e) for a, b, e in spans for f in forms(w for w in words(t[:a])[-pii.NEAR :] + words(t[b:])[: pii.NEAR] if len(w) >= pii.TERM_LENGTH)})
    corpus = Counter(f for t in texts for f in forms(words(t)))
    out = {}
    for (term, entity), n in both.items():
        whole = max(len(texts), held[entity] + 1) / held[entity]
        ratio = np.log2(whole * n / max(corpus[term], n)) / np.log2(whole)
        if n >= support and held[entity] >= support and ratio >= disclosure:
            out[term, entity] = round(float(ratio), 9)
    return out


def test_pii_terms_against_brute_force(spark):
    r = random.Random(11)
    mails = [f"u{i}@mail{i}.org" for i in range(12)]
    names = [f"{w}{i % 3 or ''}" for i, w in enumerate(WORDS[:12])]
    texts = [prose(r.randint(3, 30), i) for i in range(400)]
    for i in range(160):
        k = r.randrange(12)
        texts.append(" ".join([prose(r.randint(0, 9), 900 + i), names[k] if r.random() < 0.8 else "", mails[k], r.choice(["", "10.0.0.%d" % k]), prose(r.randint(0, 400) if i % 9 == 0 else 4, 2000 + i)]))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(x["term"], x["entity"]): round(x["ratio"], 9) for x in rows(pii.disclosing_terms(df, 3, 0.6))}
    want = brute_terms(texts, 3, 0.6)
    assert got == want and len(want) > 10
