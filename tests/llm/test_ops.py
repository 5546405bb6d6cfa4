"""Each operator: nulls, empty and long texts, ties, repeated rows, empty tables and further columns; brute force."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, minhash, mips, mixing, pieces, pii, sharding, suffix, toxicity, warc
from tessera.llm.queries import MODEL_PATH

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, size string, score string"


def docs_of(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names clash with those that operators make."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = [a + b for a in "ab cd ef gh ij kl mn".split() for b in "op qr st uv wx yz".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \t\n"), (None, "no id at all here now"), (4, "short"), (5, "x" * 200_000)]


# ---- 1 --------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, words=120):
    """Copies of a text that is not among them, with one to four changed words."""
    base, out = prose(rng, words).split(), []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS).upper() + str(rng.randint(0, 9))
        out.append(" ".join(w))
    return out


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 6)
    monkeypatch.setattr(minhash, "BLOCK", 20)
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 150)) for _ in range(40)] + family(rng, 90) + family(rng, 5)
    texts += [texts[3], texts[3].upper(), texts[50], texts[0] + " " + texts[1]]
    rng.shuffle(texts)
    rows = [(i * 3 + 7, t) for i, t in enumerate(texts)] + EDGE
    got = minhash.near_duplicates(docs_of(spark, rows).repartition(3)).collect()
    want = components_of(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    none = next(r for r in got if r["doc_id"] is None)
    assert none["component_id"] is None and none["kept"]


def test_near_duplicates_repeated_rows_and_empty_table(spark):
    rows = [(2, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (3, "z")]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert minhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0
    kept = minhash.one_of_each(docs_of(spark, rows + [(None, "q")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"] and kept.columns == docs_of(spark, rows).columns


def test_words_of_long_texts_hash_alike():
    from tessera.llm.common import joined_bytes, words_of

    text = ("ab " * 400_000 + "cd")
    data, offsets = joined_bytes([text])
    starts, ends, _ = words_of(data, offsets)
    h = minhash.word_hashes(data, starts, ends)
    assert len(set(h[:-1].tolist())) == 1 and h[-1] != h[0]


# ---- 2 and 10 ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, _id int, score string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "s") for i, v in rows], VECTORS)


def bad_vectors(dim):
    nan, inf = float("nan"), float("inf")
    return [(1000, None), (1050, [nan] * dim), (1100, [inf] * dim), (1150, [None] * dim), (None, [1.0] * dim)]


def brute_top(rows, mod, k, f):
    out = {}
    for i, v in rows:
        if i % mod == 0:
            scored = sorted((-f(v, w), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("wave", [2, 10_000])
def test_exact_topk(spark, wave, monkeypatch):
    monkeypatch.setattr(mips, "HEAD", 8)
    monkeypatch.setattr(mips, "BUCKET", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # ties
    ints = [(i, np.floor(256 * np.array(v, float))) for i, v in rows]
    want = brute_top(ints, 50, 5, lambda a, b: int(a @ b))
    df = mips.exact_topk(vectors_of(spark, rows + bad_vectors(6)).repartition(5), F.col("vec_id") % 50 == 0, 5, wave=wave)
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


def test_topk_few_rows_zero_vectors_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (3, [0.5, 0.5]), (7, [1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mips.exact_topk(vectors_of(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 3, 32768), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0)]
    assert mips.exact_topk(vectors_of(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x *= rng.choice([0.5, 1, 2], size=(1500, 1)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)]
    frame = vectors_of(spark, rows + bad_vectors(16) + [(1200 * 20, [0.0] * 16)])
    df = ann.nearest(frame, F.col("vec_id") % 20 == 0, 20)  # the settings that op2 has
    again = ann.nearest(frame.repartition(7), F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = 0
    d = x.astype(float)
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(1500), -s))[:20].tolist())
        hit += len(best & {i for i, _ in found})
        assert len(found) == 20 and q not in dict(found)
        for i, score in found:  # exactly the sum in the order of the components, as doubles
            total = 0.0
            for u, v in zip(d[i], d[q]):
                total += u * v
            assert score == total
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)
    assert len(got) == 75 and hit / (20 * 75) >= 0.9


def test_nearest_few_rows_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.5]), (5, [0.5, 0.5]), (5, [0.5, 0.5])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3), (0, 2, 5)]
    assert ann.nearest(vectors_of(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- 3 --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, _url string, headers string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "u", "h") for i, u, h in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://a.example/{i}", prose(rng, rng.randint(0, 300)) + "é") for i in range(120)]
    rows += [(200 + i, None, rows[i % 5][2]) for i in range(30)] + [(300, "http://x y\r\nz", None), (301, "u", ""), (302, "u", "w" * 300_000), (7, "again", rows[7][2])]
    path = "file://" + str(tmp_path / "a")
    files = warc.write_archives(pages_of(spark, rows).repartition(3), path)
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    want = sorted(
        (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == min(by[h or ""]) else "revisit", None if i == min(by[h or ""]) else min(by[h or ""]))
        for i, _, h in rows
    )
    for split in (997, 50_000, 10**9):
        records = warc.read_archives(spark, files, split)
        got = sorted(tuple(r) for r in warc.page_records(records).collect())
        assert [tuple(x) for x in got] == want
    texts = {r["headers"]["x-page-id"]: r["payload"] for r in records.collect() if r["record_type"] == "response"}
    assert all(texts[str(i)] == bytearray((h or "").encode()) for i, _, h in rows if i == min(by[h or ""]))
    whole = b"".join(gzip.decompress(open(f.removeprefix("file://"), "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(rows)


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_warc_members_at_every_place_around_a_block_and_a_split(block):
    import io

    def plain(raw):
        """A sequential reader: one member after another."""
        import zlib

        at, out = 0, []
        while at < len(raw):
            d = zlib.decompressobj(31)
            text = d.decompress(raw[at:])
            out.append((at, text.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4]))
            at = len(raw) - len(d.unused_data)
        return out

    rng = random.Random(33)
    for shift in range(-4, 5):
        first = b""
        while len(first) % 64 != (64 + shift) % 64:  # the second member begins `shift` bytes from a block's end
            first = warc.member(warc.record(1, "u", rng.randbytes(rng.randint(0, 90))))
        raw = first + b"".join(warc.member(warc.record(i, "u", rng.randbytes(rng.randint(0, 200)))) for i in range(2, 9))
        want, starts = plain(raw), [p for p, _ in plain(raw)]
        cuts = sorted({0, len(raw), *(min(len(raw), max(0, p + d)) for p in starts for d in range(-4, 5))})
        got = [(p, records[0][4]) for s, e in zip(cuts, cuts[1:]) for p, records in warc.members(io.BytesIO(raw), s, e, block=block)]
        assert got == want
        assert [p for p, _ in warc.members(io.BytesIO(raw), 0, len(raw), payloads=False, block=block)] == starts


def test_warc_damaged_and_long_members(spark, tmp_path):
    good, long = warc.member(warc.record(1, "u", b"x")), warc.member(warc.record(2, "u", b"ab" * 3_000_000))
    cut, bad = warc.member(warc.record(3, "u", b"y" * 500))[:-9], bytearray(warc.member(warc.record(4, "u", b"z" * 500)))
    bad[-6] ^= 1
    f = tmp_path / "x.warc.gz"
    f.write_bytes(bytes(bad) + long + good + cut)
    got = warc.read_archives(spark, ["file://" + str(f)], 1000, payloads=False).collect()
    assert sorted((r["headers"]["x-page-id"], r["payload_bytes"]) for r in got) == [("1", 1), ("2", 6_000_000)]
    assert next(r for r in got if r["payload_bytes"] > 1)["payload_digest"] == warc.sha1_base32(b"ab" * 3_000_000)


def test_warc_empty_table_and_false_magic(spark, tmp_path):
    assert warc.through_archives(pages_of(spark, []).limit(0)).count() == 0
    good = warc.member(warc.record(1, "u", b"x"))
    f = tmp_path / "x.warc.gz"
    f.write_bytes(warc.MAGIC + b"junk" + gzip.compress(b"no record") + good + b"\x1f\x8b\x08" + good)
    got = warc.page_records(warc.read_archives(spark, ["file://" + str(f)], 11)).collect()
    assert [r["page_id"] for r in got] == [1, 1]


# ---- 4 --------------------------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def base_brute(t):
    found = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = [int(c) for c in m.group() if c.isdigit()]
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2:
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled_table(spark))


def test_base_spans_against_patterns(field):
    rng = random.Random(8)
    bits = ["a", "é", "@", ".", "-", "+", " ", "1", "25", "300", "4111 1111 1111 1111", "a.b@c.de", "(555)", "\n", "x", "0000", "_%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    from tessera.llm.common import joined_bytes

    got = pii.spans_of(field, *joined_bytes(texts))
    for t, spans in zip(texts, got):
        assert [s for s in spans if s[1] < 4] == base_brute(t)


def test_field_finds_added_kinds_and_leaves_prose(field, spark):
    text = 'Call (555) 123-4567 or 555-123-9876 now. token = "0641917ea4e9feb9cda83477b57ac2654884f485" In 1999 we had 12 of them. id 123-45-6789 on file'
    found = pii.find(docs_of(spark, [(1, text), *EDGE]), field).collect()
    spans = {text[s["start"] : s["end"]]: s["kind"] for r in found if r["doc_id"] == 1 for s in r["spans"]}
    assert spans == {"(555) 123-4567": "local_phone", "555-123-9876": "local_phone", "0641917ea4e9feb9cda83477b57ac2654884f485": "secret", "123-45-6789": "national_id"}
    assert all(r["spans"] == [] for r in found if r["doc_id"] != 1) and len(found) == 7
    assert pii.find(docs_of(spark, EDGE).limit(0), field).count() == 0


def test_field_decodes_the_best_path(field):
    rng = np.random.default_rng(5)
    lengths = np.array([1, 3, 2, 4])
    e = rng.normal(size=(10, len(pii.LABELS)))
    got, at = field.decode(e, lengths), 0
    from itertools import product

    for n in lengths:
        best = max(product(range(len(pii.LABELS)), repeat=int(n)), key=lambda y: field.start[y[0]] + sum(e[at + t, y[t]] for t in range(n)) + sum(field.step[y[t - 1], y[t]] for t in range(1, n)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_digest_and_redaction(field, spark):
    d = docs_of(spark, [(1, "é a@b.cd 1.2.3.4"), (2, None)])
    rows = {r["doc_id"]: r for r in pii.digest(pii.find(d, field)).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["spans"]) == (1, 1, "email:2:8,ip:9:16")
    assert rows[1]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest() and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r for r in pii.redact(d, field).collect()}
    assert clean[1]["text"] == "é [EMAIL] [IP]" and clean[1]["n_chars"] == 14 and clean[2]["text"] is None


# ---- 5 --------------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) + (" you moron " + rng.choice(["scum", "idiot"]) if i % 4 == 0 else "") + " " + prose(rng, 60)) for i in range(600)]
    docs = docs_of(spark, rows + [(1000, None), (1001, ""), (1002, " \n"), (None, "no id"), (1003, "x" * 200_000)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out("doc_id")))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == 605 and all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert all(got[i] < 0.5 for i in (1000, 1001, 1002))
    again = toxicity.train(docs.repartition(7), labels.filter(~toxicity.held_out("doc_id")))
    assert np.allclose(again.weight, model.weight)
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def buckets_brute(text):
    """The buckets of a text's n-grams, one n-gram after another."""
    x, out = (text or "").encode(), set()
    x = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in x)
    fold = [int(v) for v in toxicity.mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))]
    base, full = int(toxicity._BASE), 2**64 - 1
    for n in toxicity.GRAMS:
        for i in range(len(x) - n + 1):
            h = sum(fold[x[i + j]] * pow(base, j, 2**64) for j in range(n)) & full
            out.add((((h ^ (h >> 29)) * (0xD6E8FEB86659FD93 + 2 * (n - 1))) & full) >> (64 - toxicity.BUCKET_BITS))
    return out


def score_brute(model, text):
    z = model.bias + sum(model.weight[model.place[b]] for b in buckets_brute(text) if model.place[b] >= 0)
    return 1 / (1 + np.exp(-min(40, max(-40, z))))


def test_toxicity_features_and_scores_against_plain_python(spark):
    rng = random.Random(19)
    rows = [(i, prose(rng, rng.randint(0, 25)) + (" You MORON" + rng.choice([" scum\tidiot", ""]) if i % 3 == 0 and rng.random() < 0.9 else "")) for i in range(300)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    held = {c: [buckets_brute(t) for i, t in rows if int(i % 3 == 0) == c] for c in (0, 1)}
    best = {}
    for b in set().union(*held[0], *held[1]):
        clean, toxic = (sum(b in x for x in held[c]) for c in (0, 1))
        if clean + toxic >= toxicity.LEAST_DOCS:
            ratio = np.log((toxic + 1) / (len(held[1]) + 2)) - np.log((clean + 1) / (len(held[0]) + 2))
            z = abs(ratio) / np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
            if z >= toxicity.LEAST_Z:
                best[b] = z
    assert set(np.flatnonzero(model.place >= 0).tolist()) == set(best) and best
    some = [(1, "you moron and scum idiot"), (2, "plain"), (3, None), (4, ""), (5, "MORON" * 3000), *((100 + i, t) for i, t in rows[:20])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, some), model, ["doc_id"]).collect()}
    assert all(got[i] == pytest.approx(score_brute(model, t), abs=1e-9) for i, t in some)


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect())


# ---- 6 --------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH), pieces.read_model(MODEL_PATH)
    rng = random.Random(10)
    bits = [" ", "  ", "   ", "▁", "th", "tion", "é", "é", "½", "\n", "\t", "日本", "😀", "er", "\x00", "<0x0A>", "</s>", "1", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + [" " * k for k in range(40)] + ["ab" * 5000, prose(rng, 3000)]
    assert [x.tolist() for x in model.encode([t.encode() for t in texts])] == sp.encode(texts)
    docs = docs_of(spark, list(enumerate(t for t in texts if "▁" not in t)) + [(None, "q"), (-1, None)])
    rows = pieces.encode(docs, model, check=True)
    assert rows.filter("not same").count() == 0
    none = rows.filter("doc_id = -1").first()
    assert none["ids"] is None and none["same"] is None
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, model).collect()}
    assert all(back[r["doc_id"]] == r["text"] for r in docs.collect())
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_unigram_paths_are_best():
    model = pieces.Model.__new__(pieces.Model)
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -3.5, "ba": -2.2, "bab": -4.1}
    model.pieces, model.scores, model.kinds, model.bpe = ["<unk>", *vocabulary], [0.0, *vocabulary.values()], [pieces.UNKNOWN] + [pieces.NORMAL] * len(vocabulary), False
    model._set_up()

    def best(t):
        if not t:
            return 0.0
        return max(s + best(t[len(p) :]) for p, s in vocabulary.items() if t.startswith(p))

    rng = random.Random(11)
    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(200)})
    for w, ids in zip(words, model.paths(words)):
        assert "".join(model.pieces[i] for i in ids) == w
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(w))


# ---- 7 --------------------------------------------------------------------------------------------------------------


def mix_brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(size.values()), set()
    while True:
        free = sum(w[s] for s in order if s not in full)
        level = (budget - sum(most * size[s] for s in full)) / free if free else 0
        new = {s for s in order if s not in full and w[s] * level >= most * size[s]}
        if not new or not free:
            return {s: most * size[s] if s in full else w[s] * level for s in order}
        full |= new


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP_BITS", 3)
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 40)), rng.choice(["a", "b", "ü", "Z", None] + ["hot"] * 6)) for i in range(400)]
    rows += [(1, "a b c", "hot"), (1, "a b c", "hot"), (2, None, "a"), (None, "x y", "b"), (3, "", "only empty")]
    got = mixing.mix(docs_of(spark, rows).repartition(3)).collect()
    want, taken = mix_brute(rows), {}
    by_id = {}
    for (i, _, s) in rows:
        by_id.setdefault(i, []).append(s)
    assert len(got) == len(rows)
    key = {r["source"]: r for r in docs_of(spark, rows).groupBy("source").count().collect()}
    assert set(key) == set(want)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] = taken.get((r["source_size"], round(r["target"], 6)), 0) + r["taken"]
    for s, target in want.items():
        assert abs(taken[(sizes[s], round(target, 6))] - target) < 5
    again = mixing.mix(docs_of(spark, rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_and_empty(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 20), "a" if i % 3 else "b") for i in range(90)]
    out = mixing.mixed_documents(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for s, target in mix_brute(rows).items():
        assert abs(n[s] * 20 - target) <= 20
    assert mixing.mix(docs_of(spark, rows).limit(0)).count() == 0 and mixing.mixed_documents(docs_of(spark, rows).limit(0)).count() == 0


# ---- 8 --------------------------------------------------------------------------------------------------------------


def repeats_brute(texts, length):
    from collections import Counter

    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))]
        out.append((spans, bytes(b for b, c in zip(t, cover) if not c)))
    return out


@pytest.mark.parametrize("block", [7, 1 << 17])
def test_suffix_sorting_against_all_strings(monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = random.Random(14)
    for _ in range(150):
        letters = rng.choice([b"a", b"ab", b"abcdefgh", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        if texts:
            texts.append(texts[0][2:] + texts[-1])
        length = rng.choice([1, 2, 4, 7])
        count = {}
        for t in texts:
            for i in range(len(t) - length + 1):
                count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
        want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix.repeated_starts(iter(texts), length)] == want


def test_suffix_order_and_common_prefixes(tmp_path, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 5)
    rng = random.Random(24)
    for n in range(120):
        letters = rng.choice([[1], [1, 2], [1, 2, 3, 4], list(range(1, 257))])
        texts = [[rng.choice(letters) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        texts += [texts[0], texts[-1][1:]]
        t = np.array([0, *(c for x in texts for c in [*x, 0]), 0, 0, 0], np.uint16)
        (folder := tmp_path / str(n)).mkdir()
        depth = rng.choice([3, 50])
        found = [(int(p), int(x)) for a, b in suffix.suffix_order(t, str(folder), depth) for p, x in zip(a, b)]
        body = lambda p: t[p : p + next(i for i in range(99) if t[p + i] == 0)].tolist()
        agree = lambda x, y: next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert sorted(p for p, _ in found) == np.flatnonzero(t).tolist()
        for (p, _), (q, common) in zip(found, found[1:]):
            assert common == min(depth, agree(body(p), body(q)))
            assert body(p)[:depth] <= body(q)[:depth]


def passages_brute(rows, length, words):
    """Whether a text holds a window (words words, or length bytes if these are fewer) that another document holds."""
    where, of = {}, []
    for d, t in rows:
        spans, own = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)], set()
        for k, (s, _) in enumerate(spans):
            ends = [e for e in (s + length, spans[k + words - 1][1] if k + words <= len(spans) else None) if e is not None and e <= len(t)]
            if ends:
                own.add((t[s : min(ends)], spans[k + words - 1][1] == min(ends) if k + words <= len(spans) else False))
        of.append(own)
        for w in own:
            where.setdefault(w, set()).add((d, t))
    return [any(len(where[w]) > 1 for w in own) for own in of]


def test_a_shard_sorts_only_what_recurs(monkeypatch, tmp_path):
    """Pieces that share a gram and no window are not sorted; of others, what lies between their windows that recur is."""
    rng = random.Random(27)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    gram, shared = text(100), text(450)
    texts = [text(200) + gram + text(200) for _ in range(20)] + [text(300) + shared + text(300) for _ in range(2)] + [text(10), b"", gram]
    sorted_letters, order = [], suffix.suffix_order

    def counted(t, *rest):
        sorted_letters.append(int((t > 0).sum()))
        return order(t, *rest)

    monkeypatch.setattr(suffix, "suffix_order", counted)
    found = [x.tolist() for x in suffix.repeated_starts(iter(texts), 400)]
    assert sorted_letters == [2 * 450]
    assert found == [[]] * 20 + [list(range(300, 351))] * 2 + [[]] * 3
    assert [x.tolist() for x in suffix.repeated_starts(iter(texts[:20]), 400)] == [[]] * 20
    # passages at which a word begins, shorter than the strings; a queue in files and in memory
    rows = [prose(rng, 60).encode() for _ in range(8)]
    middle = prose(rng, 55).encode()
    pieces = [(r + b" " + middle + b" " + r[:50], len(r) + len(middle), True, i, False) for i, r in enumerate(rows)] + [(rows[0][:300], 300, True, 9, False)]
    kept = suffix._shard(iter(pieces), 400, 51)
    monkeypatch.setattr(suffix, "HELD", 7)
    again = suffix._shard(iter(pieces), 400, 51)
    assert kept[1].tolist() == again[1].tolist() == passages_brute([(d, x) for x, _, _, d, _ in pieces], 400, 51)
    assert [a.tolist() for a in kept[0]] == [a.tolist() for a in again[0]]


def test_without_repeats(spark, monkeypatch):
    rng = random.Random(15)
    passage, other = prose(rng, 30), prose(rng, 25)
    texts = [prose(rng, 40) for _ in range(20)] + [prose(rng, 10) + passage + prose(rng, 12) for _ in range(6)]
    texts += [prose(rng, 5) + other + "é" + other + prose(rng, 5), passage, passage, "a" * 500, texts[0], texts[0][:70], "", None, "x" * 79]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, passage)]
    got = suffix.without_repeats(docs_of(spark, rows).repartition(3), length=80).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = sorted((str(i), len(t), [list(s) for s in spans], kept) for (i, _), t, (spans, kept) in zip(rows, raw, repeats_brute(raw, 80)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], [[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in got) == want
    monkeypatch.setattr(suffix, "PIECE", 150)
    again = suffix.digest(suffix.without_repeats(docs_of(spark, rows), length=80)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in again) == sorted((i, sum(e - s for s, e in spans), hashlib.sha256(k).hexdigest()) for i, _, spans, k in want)
    assert suffix.without_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_repeats_and_passages_of_short_windows(spark, monkeypatch):
    """Passages of ten words or more, most shorter than the 60 bytes of a string that is removed."""
    rng = random.Random(25)
    short = [prose(rng, 12) for _ in range(6)] + [" ".join(rng.choice("abcdefghij") for _ in range(25)) for _ in range(4)]
    texts = []
    for k in range(60):
        a, b = prose(rng, rng.randint(0, 25)), prose(rng, rng.randint(0, 25))
        middle = rng.choice(short) if k % 3 else prose(rng, 10)
        texts.append(f"{a} {middle[: rng.choice([200, 200, 45])]}{rng.choice([' ', chr(9), 'zz ', chr(1)])}{b}")
    texts += [texts[4], "a b " * 200, texts[5].replace(" ", "\n", 1), "same " * 30, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    raw = [(t or "").encode() for _, t in rows]
    want = sorted(zip((i for i, _ in rows), (sum(e - s for s, e in spans) for spans, _ in repeats_brute(raw, 60)), passages_brute([(i, r) for (i, _), r in zip(rows, raw)], 60, 10)))
    assert 20 < sum(w[2] for w in want) < len(want)
    for piece in (8_000_000, 90):
        monkeypatch.setattr(suffix, "PIECE", piece)
        got = suffix.digest(suffix.without_repeats(docs_of(spark, rows).repartition(3), length=60, words=10)).collect()
        assert sorted((r["doc_id"], r["n_removed"], bool(r["shares_passage"])) for r in got) == want


# ---- 9 --------------------------------------------------------------------------------------------------------------


def test_curve_visits_neighbours():
    """The curve passes every grid point once, and each step goes to a neighbour."""
    from tessera.llm.hilbert import hilbert_index

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_index(points, bits)
        assert sorted(index.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_against_a_plain_order(spark, tmp_path):
    import zlib

    from tessera.llm.hilbert import hilbert_index

    rng = random.Random(26)
    full = [(i, prose(rng, rng.randint(0, 300)) if i % 17 else None, rng.choice(["de", "en", "es", "fr"]), rng.choice([f"src{k}" for k in range(20)])) for i in range(800)]
    full += [(900, "x", None, "src1"), (901, "x", "en", None), (902, "é" * 9000, "en", "src1")]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").repartition(5)
    name = lambda v: "b" if v is None else "a" + v
    meta = []
    for i, t, lang, source in full:
        raw = (t or "").encode()
        size = len(raw) + 1
        digits = bin(size)[2:]
        meta.append((name(lang), name(source), 2 * (len(digits) - 1) + (digits[1:2] == "1"), zlib.crc32(raw), i, size))
    codes = []
    for d in range(3):
        values = sorted({m[d] for m in meta})
        codes.append([values.index(m[d]) * 64 // len(values) for m in meta])
    order = sorted(range(len(meta)), key=lambda k: (int(hilbert_index(np.array([[c[k] for c in codes]]), 6)[0]), *meta[k][3:]))
    want = {}
    for rank, k in enumerate(order):
        shard = rank * 8 // len(meta)
        want[meta[k][4]] = (shard, rank - -(-shard * len(meta) // 8))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_plan(docs).collect()}
    assert got == want
    # a filter on a language, on a source or on short texts skips files by their minima and maxima
    sharding.write_shards(docs, str(tmp_path / "s"), files=64)
    import pyarrow.dataset as ds

    files = [f.to_table() for f in ds.dataset(str(tmp_path / "s"), format="parquet").get_fragments()]
    assert sum(f.num_rows for f in files) == len(full)

    def skipped(column, low, high):
        spans = [[v for v in f[column].to_pylist() if v is not None] for f in files]
        return sum(not v or max(v) < low or min(v) > high for v in spans) / len(files)

    assert all(skipped("lang", v, v) > 0.5 for v in ("de", "en", "es", "fr"))
    assert sum(skipped("source", f"src{k}", f"src{k}") for k in range(20)) / 20 > 0.5
    sizes = [[len((t or "").encode()) for t in f["text"].to_pylist()] for f in files]
    assert sum(min(v) > 200 for v in sizes) / len(files) > 0.3


def test_columns_whose_names_clash(spark, tmp_path):
    """Further columns of any name come through the stages and the shard writer unchanged."""
    import corpus_pipeline

    names = "score score_ target source_size _size _h _skey _taken shard shard_ slot _k _id _row _text _order size doc".split()
    rng = random.Random(27)
    rows = [(i, prose(rng, rng.randint(0, 40)), "en", "ab"[i % 2]) for i in range(60)] + [(60, None, None, None), (None, "a b", "en", "a"), (61, "", "en", "a"), (3, "other words here", "en", "a"), (61, "", "en", "a")]
    full = [(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    known = {f[4]: f for f in full}
    sf = "/root/testdata/sf0.001"
    for stage, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == docs.columns, stage
        found = [tuple(r) for r in out.collect()]
        assert found and all(known[f[4]] == f or (stage == "personal data" and known[f[4]][4:] == f[4:]) for f in found), stage
        assert function(spark, docs.limit(0), sf).count() == 0, stage
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert kept.count(3) == 2 and kept.count(61) == 1 and kept.count(None) == 1  # a repeated id: other words stay, equal rows are one
    unique = docs.filter("doc_id < 60 and doc_id <> 3")
    sharding.write_shards(unique, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in back.select(*docs.columns).collect()) == sorted(tuple(r) for r in unique.collect()) and "shard__" in back.columns
    with pytest.raises(ValueError, match="repeats"):
        sharding.write_shards(docs, str(tmp_path / "t"))


def test_shards(spark, tmp_path):
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "b", "c", None] + ["hot"] * 4)) for i in range(203)] + [(1, None), (None, "é"), (5, "same"), (5, "same")]
    import zlib

    got = sharding.shard_plan(docs_of(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_plan(docs_of(spark, rows).limit(0)).count() == 0
    assert sorted(r["shard"] for r in sharding.shard_plan(docs_of(spark, rows[:3])).collect()) == sorted({0 * 8 // 3, 8 // 3, 16 // 3})
    unique = docs_of(spark, rows[:200])
    sharding.write_shards(unique, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, unique.select("doc_id", "text").collect()))
