"""The training-data operators against brute force, with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from anvaya.llm import (
    decontaminate, langid, licenses, neardup_vectors, packing, pagetext, quality, repeats, secrets, simhash,
)
from anvaya.llm.common import connected_components

WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = text_of(rng, 120)
    texts = [base, base, base + " extra", text_of(rng, 40), "", None, " \n\t", "one two", "x" * 30_000, text_of(rng, 3000)]
    texts += [text_of(rng, rng.randint(1, 200)) for _ in range(20)]
    texts += [base[:400] + text_of(rng, 30), text_of(rng, 20) + base[100:500]]
    out = [(n, t, "l%d" % (n % 2), "en", "clash") for n, t in enumerate(texts)]
    return [*out, out[3], (None, texts[3], "l0", "en", None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns carry names that the operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, lang string, h string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"), "t")
    assert {r["node"]: r["component"] for r in found.collect()} == {x: label[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), "t").count() == 0


def plain_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty, rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    near = [[k for k, g in enumerate(fps) if (f ^ g).bit_count() <= 2] for f in fps]
    component = [float("inf") if i is None else i for i in ids]
    for _ in rows:
        component = [min(component[k] for k in own) for own in near]
    found = simhash.near_duplicates(docs).collect()
    expected = sorted((str(i), f"{f:016x}", c) for i, f, c in zip(ids, fps, component))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({int(c) for c in component})


def test_representatives_keep_texts_and_clashing_columns(spark):
    rng = random.Random(14)
    a, b, c = (text_of(rng, 60) for _ in range(3))
    rows = [(5, a, "1"), (5, b, "2"), (9, b, "3"), (None, c, "4"), (None, c, "5"), (None, a, "6"), (7, c + " tail", "7"), (5, a, "1"), (None, "lone text", "8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string").withColumn("identity", F.lit(1))
    kept = simhash.keep_representatives(docs)
    fps = {c: plain_fingerprint(c), c + " tail": plain_fingerprint(c + " tail")}
    linked = (fps[c] ^ fps[c + " tail"]).bit_count() <= 2
    want = [("5", a), ("5", b), ("7", c + " tail"), ("None", "lone text")] + ([] if linked else [("None", c)])
    assert kept.columns == docs.columns and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted(want)
    assert simhash.keep_representatives(docs.where("false")).count() == 0

def test_simhash_tiles_agree(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(b) for b in base} | {int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 4)}
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame(rows, "rep long, fp long")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (2**64 - 1)).bit_count() <= 2}
    for tile_rows in (8192, 1):
        links = connected_components(simhash.tile_links(df, tile_rows=tile_rows), "t")
        got = {r["node"]: r["component"] for r in links.collect()}
        label = {x: x for p in want for x in p}
        for _ in range(50):
            for a, b in want:
                label[a] = label[b] = min(label[a], label[b])
        assert got == label


def test_packing(docs, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(docs, path, max_len=64).toPandas()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    want = []
    for doc_id, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((str(doc_id), piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = [(str(None if np.isnan(a) else int(a)), *map(int, b)) for a, *b in found[
        ["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got) == sorted(want)
    for _, part in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert part.length.sum() <= 64
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 64 + 1
    assert packing.pack(empty, path).count() == 0


def test_tokenizer_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    own = packing.WordTokenizer(path)
    for text in ["", "ΑΣ Σας", "été", "a\x1cb c", "<|endoftext|> it's we'll", "x<|startoftext|>y<|ENDOFTEXT|>", "İstanbul", "日本語 テキスト", "x\x00y 　z", "½²Ⅷ 12"]:
        assert own.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_tokenizer_every_code_point():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) != "Co"]
    known = [c for c in points if unicodedata.category(c) != "Cn"]
    unknown = [c for c in points if unicodedata.category(c) == "Cn" and ord(c) < 0x20000]
    for group in (known, unknown):
        for at in range(0, len(group), 400):
            part = group[at : at + 400]
            text = " ".join(f"Ab{c}b {c}" for c in part)
            want = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert own.ids(text) == want, hex(ord(part[0]))


def test_small_histograms_are_fitted():
    places = packing.plan({2048: 10, 1024: 6, 3072: 6, 100: 1})
    assert places[places.offset == 0].eval("last - first").sum() == 12
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, b = rng.random((20, 60)), rng.random(20) * 10
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max() < 1e-6
    assert packing.plan({}).empty


def test_plan_fills_sequences():
    rng = np.random.default_rng(2)
    lengths = np.exp(rng.normal(6, 1.2, 20_000)).astype(int) + 1
    lengths = lengths[lengths < 4096]  # full pieces have no place in the plan
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    places = packing.plan(histogram)
    count = (places["last"] - places["first"]).groupby(places["length"]).sum().to_dict()
    assert count == histogram
    sequences = places[places.offset == 0].eval("last - first").sum()
    assert sequences <= 1.02 * lengths.sum() / 4096 + 1


def test_secrets(docs, empty, spark):
    der_rsa = b"\x30\x1c" + b"\x02\x01\x00" + b"\x02\x01\x05" * 2 + b"\x02\x01\x07" * 6 + b"\x02\x01\x01"
    assert not secrets.is_key(der_rsa[:-1]) and not secrets.is_key(b"\x30\x80" + bytes(30))
    parts = b"\x02\x01\x00" + b"".join(b"\x02\x04" + bytes([1, k, 2, 3]) for k in range(8))
    der = b"\x30" + bytes([len(parts)]) + parts
    key64 = base64.b64encode(der).decode()
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    body = base64.urlsafe_b64encode(b'{"sub":"1"}').decode().rstrip("=")
    token = f"{head}.{body}.{'A' * 43}"
    text = f'é password: "abc" secret=abcdefgh1 AKIASHORT AKIA{"B" * 16} {"0af9" * 10} {key64} {token} {der.hex()}'
    got = secrets.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["n_assign"], got[0]["n_access"], got[0]["n_hex"]) == (1, 1, 2)
    base = secrets.base_spans(text)
    assert got[0]["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    kinds = [x.split(":")[0] for x in got[0]["spans"].split(",")]
    assert kinds.count("key") == 2 and kinds.count("jwt") == 1
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = secrets.redacted(text)
    assert not secrets.base_spans(clean) and not secrets.added_spans(clean) and clean.startswith("é password")
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty).count() == 0
    assert secrets.redact(docs).columns == docs.columns
    assert not secrets.is_signed_token("eyJhIjoxfQ.eyJhIjoxfQ.") and not secrets.is_key(secrets.decode64("QUJD" * 20))


def test_keys_escaped_nested_wrapped_and_glued():
    parts = b"\x02\x01\x00" + b"\x02\x82\x01\x01" + b"\x01" * 257 + b"".join(b"\x02\x04" + bytes([1, k, 2, 3]) for k in range(7))
    der = b"\x30\x82" + len(parts).to_bytes(2, "big") + parts
    field = lambda b: len(b).to_bytes(4, "big") + b
    box = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + b"\0\0\0\1" + field(b"p" * 51) + field(b"q" * 130)
    assert secrets.is_key(der) and secrets.is_key(box) and not secrets.is_key(box[:-1])
    for raw in (der, box):
        key = base64.b64encode(raw).decode()
        lines = [key[k : k + 64] for k in range(0, len(key), 64)]
        pem = "\n".join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
        twice = base64.b64encode(pem.encode()).decode()
        for secret, kind in (
            (pem, "armour"), (json.dumps(pem + "\n")[1:-3], "armour"), (json.dumps(json.dumps(pem))[3:-3], "armour"),
            (pem.replace("\n", "\r\n"), "armour"), (pem.replace("\n", ""), "armour"), (pem.replace("\n", "\\n").replace("/", "\\/"), "armour"),
            (twice, "key"), ("\n".join(twice[k : k + 76] for k in range(0, len(twice), 76)), "key"),
            (base64.b64encode(key.encode()).decode(), "key"), ("\n".join(lines), "key"), ("\\n".join(lines), "key"), (" ".join(lines), "key"),
            ("\r\n  ".join(lines), "key"), (key, "key"), (raw.hex(), "key"), ("\n".join(raw.hex()[k : k + 60] for k in range(0, 2 * len(raw), 60)), "key"),
        ):
            text = f'é {{"k": "{secret}", "more": 1}}'
            assert secrets.added_spans(text) == [(kind, 9, 9 + len(secret))], (kind, secret[:80])
            assert secrets.redacted(text) == 'é {"k": "[SECRET]", "more": 1}'
        bare = key.rstrip("=")
        for glue in ("/", "-", "_", "a", "ab", "abc", "path/to/", "\\n"):
            assert secrets.added_spans(f"x {glue}{bare} y") == [("key", 2 + len(glue), 2 + len(glue) + len(bare))], glue
        assert secrets.added_spans(f"{bare}\nand then words\n") == [("key", 0, len(bare))]
        wrong = base64.b64encode(raw[:-9]).decode()
        assert secrets.added_spans(wrong) == [] and secrets.added_spans("\n".join(lines[:-1])) == []
    head, body = (base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}'))
    token = base64.b64encode(f"{head}.{body}.{'A' * 43}".encode()).decode()
    assert secrets.added_spans(f"t {token} u") == [("jwt", 2, 2 + len(token))]


def test_signed_tokens_however_they_start():
    body, sign = base64.urlsafe_b64encode(b'{"sub":"1"}').decode().rstrip("="), "A" * 43
    for header in (b'{"alg":"HS256"}', b'{ "alg":"HS256"}', b'{\n "alg": "RS256", "k": {"a": [1]}}', b'{\t"typ":"JWT","alg":"none"}', b'\n{"alg":"HS256"}'):
        head = base64.urlsafe_b64encode(header).decode().rstrip("=")
        token = f"{head}.{body}.{sign}"
        lead = 1 if header[:1] == b"\n" else 0  # white space in front is no part of a header that stands in a longer run
        for before in ("", "x ", "Bearer=", "a.b.", "k_", "abc-", "://h/"):
            found = secrets.added_spans(f"{before}{token} y")
            assert [x[0] for x in found] == ["jwt"] and found[0][2] == len(before) + len(token), (header, before)
            assert len(before) <= found[0][1] <= len(before) + 2 * lead or before.endswith(("_", "-")), (header, before)
    assert secrets.added_spans(f"{body}.{body}.{sign}") == []


def test_long_odd_texts_are_scanned_in_linear_time():
    for unit in ("eyJ", "eyJ.", "ey.", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\n", "MII", "30820", "password ", "A\n", "a" * 40 + "\n"):
        text = unit * (300_000 // len(unit))
        began = time.time()
        secrets.scan_text(text)
        assert time.time() - began < 20, unit


def test_base_spans_brute():
    rng = random.Random(9)
    bits = ["token", "Api_Key", "apikey", '="', ": ", "=", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "ſecret=abcdefghij", " ", "x", "passwd'", "=abcdefgh"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(12))
        want = []
        either = "|".join(
            re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", w) for w in ("password", "passwd", "secret", "token", "api_?key")
        )
        pattern = rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        want += [("assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert secrets.base_spans(text) == sorted(want, key=lambda s: (s[1], secrets.ORDER[s[0]], s[2]))


def brute_contamination(rows, items, size):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    times = {}
    for _, text, *_ in rows:
        for word in words(text):
            times[word] = times.get(word, 0) + 1
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        hit, found, passages, near = set(), set(), set(), 0
        for phrase, ids in windows.items():
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit.update(range(k, k + len(phrase)))
                    found.update(str(i) for i in ids if i is not None)
                    passages |= {k} if len(phrase) == size else set()
            chosen = sorted(set(phrase), key=lambda t: (sum(t in p for p in windows), hashlib.md5(t.encode()).hexdigest()))[:4]
            order = sorted((times.get(t, 0), phrase.index(t), t) for t in chosen)[:3]
            starts = [k - order[0][1] for k, t in enumerate(w) if t == order[0][2] and order[0][0]]
            near += any(
                all(any(w[p] == t for p in range(max(0, s + n - 4), min(len(w), s + n + 5))) for _, n, t in order[1:]) for s in starts
            )
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc_id), len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w), len(passages), near))
    return sorted(out)


def test_decontamination(spark, docs, empty, rows):
    base = rows[0][1].split()
    items = [(1, " ".join(base[5:30])), (2, "theta"), (3, " ".join(base[40:46]).upper()), (4, ""), (5, None), (11, " ".join(base[10:40])),
             (None, " ".join(base[60:80])), (2, "theta"), (7, "never seen words here"), (8, "x" * 30_000)]
    bench = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id long, text string, doc_id string")
    for size in (13, 4):
        got = decontaminate.contamination(docs, bench, size).collect()
        have = sorted(tuple([str(r["doc_id"]), *r[1:]]) for r in got)
        assert have == brute_contamination(rows, items, size)
    assert decontaminate.contamination(empty, bench).count() == 0
    clean = decontaminate.contamination(docs, bench.where("false"))
    assert clean.count() == docs.count() and clean.where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    want = [r[0] for r in brute_contamination(rows, items, 13) if not r[5] and not r[6]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(want)


def test_decontamination_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(1, " ".join(rows[0][1].split()[5:30])), (2, "theta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted(tuple([str(r["doc_id"]), *r[1:]]) for r in got) == brute_contamination(rows, items, 13)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y a z z z z b"), (2, "b a")], "doc_id long, text string")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, left_term string, right_term string")
    got = decontaminate.proximity_matches(docs, pairs, 2).collect()
    assert sorted((r["doc"], r["left_at"], r["right_at"]) for r in got) == [(1, 0, 2), (1, 4, 2), (2, 1, 0)]


def test_long_document_with_one_window_goes(spark):
    rng = random.Random(4)
    item = " ".join(rng.choices(WORDS, k=20))
    filler = [text_of(rng, 2000), text_of(rng, 2000)]
    docs = spark.createDataFrame(
        [(1, filler[0] + " " + " ".join(item.split()[3:16]) + " " + filler[1], "x"), (2, filler[0], "x"), (3, filler[1] + " odd one", "x"), (None, None, "x")],
        "doc_id long, text string, text_hash string",
    )
    bench = spark.createDataFrame([(1, item), (2, "odd one")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]


def test_repeats(spark, docs, empty, rows, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    want = brute_repeats(rows)
    for hot in (4000, 1, 0):
        monkeypatch.setattr(repeats, "HOT_SEGMENTS", hot)
        got = repeats.remove_repeats(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert repeats.remove_repeats(empty).count() == 0


def brute_repeats(rows, span=200):
    texts = [(r[1] or "").encode() for r in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - span + 1):
            seen[t[k : k + span]] = seen.get(t[k : k + span], 0) + 1
    out = []
    for row, t in zip(rows, texts):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - span + 1):
            if seen[t[k : k + span]] > 1:
                gone[k : k + span] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        out.append((str(row[0]), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_sort():
    rng = np.random.default_rng(0)
    for _ in range(10):
        base = rng.integers(97, 99, 500, dtype=np.uint8)
        buffer = np.concatenate([base, base[:450], rng.integers(97, 99, 100, dtype=np.uint8), base[50:400], np.full(400, 97, np.uint8), np.zeros(16, np.uint8)])
        starts = np.arange(len(buffer) - 216)
        order, group = repeats.equal_spans(buffer, starts)
        data = buffer.tobytes()
        spans = [data[k : k + 200] for k in order]
        assert spans == sorted(spans)
        assert [a == b for a, b in zip(spans, spans[1:])] == (group[1:] == group[:-1]).tolist()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    data = []
    for k in range(700):
        v = centres[k % 12] + rng.normal(size=64) * (0.09 if k % 3 else 0.3)
        data.append((k, v.astype(np.float32).tolist(), int(k % 12) % 4, "x"))
    data += [(900, data[0][1], 0, "x"), (900, data[0][1], 0, "x"), (901, None, 1, "x"), (902, [0.0] * 64, 1, "x"), (903, [], 1, "x"),
             (904, [float("nan")] * 64, 1, "x"), (905, [None] * 64, 1, "x"), (906, data[1][1], None, "x"), (907, data[1][1][:10], 1, "x"), (908, [float("inf")] * 64, 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, copies string")
    got = {}
    for r in neardup_vectors.link_vectors(df, tile_rows=40).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    usable = [r for r in data if r[1] and r[2] is not None and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    m = np.array([r[1] for r in usable], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in usable])
    link = (m @ m.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    true = int(link.sum())
    found = sum(x[0] for own in got.values() for x in own)
    for n in (2, 1000, 10**6, 10**9):
        tables, bits = neardup_vectors.table_sizes(n)
        assert 2**bits >= n and (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 0.002
    assert true > 500 and 0.99 * true <= found <= true  # recall against brute force; never a false link
    for r in data:
        if r not in usable:
            assert got[r[0]] == [(0, r[0], True)]
    assert all(x[2] == (vec == x[1]) for vec, own in got.items() for x in own)
    assert neardup_vectors.link_vectors(df.where("false")).count() == 0
    assert neardup_vectors.link_vectors(df.where("vec_id = 901")).count() == 1


def test_language(spark, docs, empty):
    rng = random.Random(6)
    words = {"aa": ["the", "thing", "with", "other"], "bb": ["der", "nicht", "und", "schon"]}
    data = [(n, " ".join(rng.choice(words[k]) + rng.choice(["", "er", "ing"]) for _ in range(30)), k) for n, k in
            ((n, rng.choice(["aa", "bb"])) for n in range(300))]
    data += [(1000, None, "aa"), (1001, "123 --", "aa"), (1002, "the thing", None), (None, "der und nicht", "bb"), (1003, "語" * 5000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.identify(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in data if r[0] is not None and r[0] < 300 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 30 and all(by_id[r[0]]["held_out"] and by_id[r[0]]["lang_pred"] == r[2] for r in held)
    assert by_id[1000]["lang_pred"] == by_id[1001]["lang_pred"] == "und" and by_id[1001]["score"] == 0
    assert by_id[1002]["lang_pred"] == "aa" and by_id[None]["lang_pred"] == "bb" and not by_id[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got) and by_id[1003]["lang_pred"] in ("aa", "bb")
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert langid.identify(empty, path).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string")), path).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocabulary = langid.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {}
    for length, (hashes, numbers) in vocabulary.by_length.items():
        pieces.update({(length, int(h)): int(n) for h, n in zip(hashes, numbers)})

    def piece(text):
        h = 0
        for c in text:
            h = (h * 1_000_003 + ord(c)) % 2**64
        return pieces.get((len(text), h), vocabulary.size if len(text) == 1 else None)

    rng = np.random.default_rng(1)
    p = rng.random((vocabulary.size + 1, 2))

    def total(text, k):
        if not text:
            return 1.0
        cuts = ((piece(text[:n]), text[n:]) for n in range(1, len(text) + 1))
        return sum(p[x, k] * total(rest, k) for x, rest in cuts if x is not None)

    words = ["the", "thing", "語z", "a", "हिन्दी"]
    got = langid.log_probabilities(words, vocabulary, p)
    for n, word in enumerate(words):
        for k in range(2):
            assert np.isclose(np.exp(got[n, k]), total("▁" + word, k))


def test_long_runs_are_summed_whole(monkeypatch):
    vocabulary = langid.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(7)
    p = rng.random((vocabulary.size + 1, 3)) / 10
    words = ["".join(rng.choice(list("theringanostdu語")) for _ in range(n)) for n in (1, 12, 24, 25, 40)]
    counts = rng.integers(0, 5, (len(words), 3)) + 1.0
    found = []
    for batched, part in ((200, 65_536), (24, 65_536), (0, 40), (0, 17)):
        monkeypatch.setattr(langid, "BATCHED", batched)
        monkeypatch.setattr(langid, "PART", part)
        found.append((langid.log_probabilities(words, vocabulary, p), langid.learn(words, counts, vocabulary)))
    for logs, learned in found[1:]:
        assert np.allclose(logs, found[0][0]) and np.allclose(learned, found[0][1])
    began = time.time()
    assert np.isfinite(langid.log_probabilities(["語x" * 100_000], vocabulary, p)).all() and time.time() - began < 30


def test_letters_keep_their_marks():
    assert langid.words_of("हिन्दी भाषा, ½² x̂y 1st") == ["हिन्दी", "भाषा", "x̂y", "st"]


def test_expected_counts_brute():
    vocabulary = langid.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    words, counts = ["the", "thing"], np.array([[2.0], [1.0]])
    p = np.full(vocabulary.size + 1, 1.0 / vocabulary.size)
    p[-1] = langid.UNKNOWN
    expected = np.zeros(vocabulary.size + 1)
    for word, n in zip(words, counts[:, 0]):
        arcs = langid.long_arcs(word, vocabulary)

        def ways(end):
            return [[]] if end == 0 else [w + [x] for start, x in arcs[end] for w in ways(start)]

        every = ways(len(word) + 1)
        mass = [np.prod(p[w]) for w in every]
        for w, m in zip(every, mass):
            np.add.at(expected, w, n * m / sum(mass))
    want = expected[:-1] + langid.SMOOTHING
    assert np.allclose(langid.learn(words, counts, vocabulary, rounds=1)[:-1, 0], want / want.sum())


def test_pages(spark):
    site = lambda n, body: (n, f"http://h.org/a/{n}", f"<html><head><title>t</title></head><body><div>Site name</div><div>Menu</div>{body}<div>Imprint</div></body></html>")
    pages = [
        (1, "http://x.org/1", '<html><script>var a="</p>";</script><nav>n</nav><div class="ad">b</div><article><h1>T &amp; U</h1><p><b>one\n two<br><p>three</article><footer>f</footer>'),
        (2, None, None), (3, "not a url", ""), (4, "http://y.org/", "<p>alone</p><form>f</form><!-- c --><section class='comments'>r</section>"),
        site(10, "<div>first story</div>"), site(11, "<div>second story</div>"), (12, "http://h.org/a/12", None), site(13, "<div>third</div>"), site(13, "<div>third</div>"),
        (20, "http://z.org/1", "<p>same</p>"), (21, "http://z.org/2", "<p>same</p>"),
    ]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, core string")
    got = {}
    for r in pagetext.main_text(df).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == ["T & U\none two\nthree"] and got[2] == [""] and got[3] == [""] and got[4] == ["alone"]
    assert got[10] == ["first story"] and got[11] == ["second story"] and got[12] == [""] and len(got[13]) == 2
    assert got[20] == got[21] == ["same"]
    assert pagetext.main_text(df.where("false")).count() == 0


def text_lines(page):
    return [t for t, kind in pagetext.lines_of(page) if kind != 2]


def test_marks_around_the_article():
    story = "<h1>Title</h1><p>A long story.</p>"
    want = ["Title", "A long story."]
    for page in (
        f'<body class="page no-sidebar"><nav>n</nav><article>{story}</article></body>',
        f'<div class="layout sidebar"><div class="sidebar">s</div><article>{story}</article></div>',
        f'<div id="search-results">{story}</div>', f'<div class="has-sidebar">{story}</div>',
        f'<article class="post sponsored">{story}</article>', f'<main><article class="post sponsored">{story}</article></main>',
        f'<div data-hidden="false" data-class="ad" title=" class=ad "><article>{story}</article></div>',
        f'<form id="page"><main>{story}</main></form>',
        f'<article>{story}</article><section class="comments"><article>r</article><article>r, longer than the story</article></section>',
        f'<article><div class="ad">{story}</div></article>',
    ):
        assert text_lines(page) == want, page
    for inner in ('<div class="comment-text">r</div>', '<p class="ad-content">b</p>', '<div id="newsletter-body">n</div>', '<ul class="related-content"><li>x</ul>'):
        assert text_lines(f"<article>{story}{inner}</article>") == want, inner
    assert text_lines(f'<article class="story-ad-free">{story}</article>') == want
    for page in (f"<main><article>{story}</article><article>Teaser</article></main>", f"<article>Teaser</article><article>{story}</article>"):
        assert text_lines(page) == want
    assert text_lines("<article>one of two</article><article>two of two</article>") == ["one of two", "two of two"]
    assert text_lines(f"<div hidden><article>{story}</article></div><p>seen</p>") == ["seen"]
    assert text_lines('<div class="ad">b</div><nav>n</nav>') == []


def test_long_odd_pages_are_read_in_linear_time():
    for unit in ("<a ", '<a "', "<a '\"", "<", "<!", "<!-- ", '<a ">" ', "<div>", "<nav><article>x", "</p>", "<p class='ad'>x", "<b><i>", "&amp;", "<script>"):
        page = unit * (2_000_000 // len(unit))
        began = time.time()
        pagetext.lines_of(page)
        assert time.time() - began < 15, unit


def test_differencing_decides_on_every_page(spark):
    page = lambda n: f"<nav>Home</nav><div>Site</div><article>Story {n}</article><div class='comment'>Reply {n}</div><footer>Imprint</footer>"
    df = spark.createDataFrame([(n, f"http://h.org/a/{n}", page(n)) for n in range(6)] + [(9, None, page(9))] * 2, "page_id long, url string, html string")
    got = pagetext.main_text(df).collect()
    assert {(r["page_id"], r["text"], r["n_lines"], r["n_shared"], r["n_marked"]) for r in got} == {
        (n, f"Story {n}", 5, 3, 1) for n in range(6)} | {(9, "Story 9", 5, 0, 3)}
    assert len(got) == 8


def brute_pages(pages):
    """Texts by the rules as written: copies, partners and a table of common subsequences."""
    lines = [pagetext.lines_of(h) for _, _, h in pages]
    places = [pagetext.host_and_path(u) for _, u, _ in pages]
    order = sorted((k for k in range(len(pages)) if places[k][0]), key=lambda k: (places[k], k))
    out = []
    for k in range(len(pages)):
        kinds = [x for _, x in lines[k]]
        unmarked = [t for t, x in lines[k] if x != 2]
        total, best = sum(map(len, unmarked)), None
        for side, step in ((0, -1), (1, 1)) if places[k][0] else ():
            at = order.index(k) + step
            while 0 <= at < len(order) and places[order[at]][0] == places[k][0]:
                held = {t for t, x in lines[order[at]] if x != 2}
                same = sum(len(t) for t in unmarked if t in held)
                if not (same == total or (2 * same > total and same >= 200)):
                    found = (pagetext.common(places[k][1], places[order[at]][1]), -side, order[at])
                    best = max(best, found, key=lambda x: x[:2]) if best else found
                    break
                at += step
        gone = None
        if best:
            a, b = [t for t, _ in lines[k]], [t for t, _ in lines[best[2]]]
            table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
            for i in range(len(a) - 1, -1, -1):
                for j in range(len(b) - 1, -1, -1):
                    table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
            gone = table[0, 0]
        out.append((kinds, [t for t, _ in lines[k]], gone))
    return out


def test_pages_brute(spark):
    rng = random.Random(21)
    pages = []
    for n in range(60):
        site = rng.choice(["a.org", "b.org"])
        body = "".join(f"<p>{site} {rng.randint(0, 5)} {'long ' * rng.randint(1, 9)}</p>" for _ in range(rng.randint(0, 6)))
        parts = [f"<nav>menu {site}</nav>", f"<div>{site}</div>", f"<article>{body}</article>" if rng.random() < 0.5 else body, f"<div>end {site}</div>"]
        pages.append((n, f"http://{site}/{rng.randint(0, 3)}/{n:02}", "".join(parts)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pagetext.main_text(df).collect()}
    for (n, _, _), (kinds, texts, common) in zip(pages, brute_pages(pages)):
        row = got[n]
        assert row["n_lines"] == len(kinds)
        kept = row["text"].split("\n") if row["text"] else []
        if common is None:
            left = [t for t, x in zip(texts, kinds) if x in (0, 3)] or [t for t, x in zip(texts, kinds) if x == 1]
            assert kept == left
        else:
            article = [t for t, x in zip(texts, kinds) if x == 0]
            rest = iter(t for t, x in zip(texts, kinds) if x != 2)
            assert all(t in rest for t in kept) and all(t in kept for t in article)
            assert row["n_shared"] <= common  # what the article keeps is not counted
            if not article and row["n_shared"] < common:
                assert kept == [t for t, x in zip(texts, kinds) if x == 1]  # nothing else was left


def page_texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in pagetext.main_text(df).collect()}


def test_pages_with_article_are_differenced(spark):
    teaser = lambda n: (n, f"http://t.org/a/{n}", f"<div>Site</div><article>card {n}</article><div>The body of {n}, in full.</div><p>Imprint</p>")
    wide = lambda n: (n, f"http://m.org/a/{n}", f"<main><div>Site</div><p>Story {n} is told.</p><p>Imprint</p></main>")
    got = page_texts(spark, [teaser(1), teaser(2), wide(3), wide(4), (5, "http://one.org/", "<p>site</p><article>own</article>")])
    for n in (1, 2):
        assert got[n] == f"card {n}\nThe body of {n}, in full."
    for n in (3, 4):
        assert got[n] == f"Story {n} is told."
    assert got[5] == "own"  # no partner, so nothing tells the site's lines


def test_near_copies_of_pages_keep_their_text(spark):
    story = [f"Paragraph {k} of the story, with some words in it." for k in range(30)]
    page = lambda path, lines: f"<div>Site</div>{''.join(f'<p>{t}</p>' for t in lines)}<div>Imprint</div>"
    many = [(n, f"http://c.org/b/{n:02}", page(n, [f"Day {n}", *story])) for n in range(11)]
    alone = [(n, f"http://d.org/b/{n}", page(n, [f"Day {n}", *story])) for n in (20, 21)]
    other = [(30, "http://c.org/a/1", page(1, ["Quite another page."])), (31, "http://c.org/c/1", page(1, ["A third page."]))]
    got = page_texts(spark, [*many, *alone, *other])
    for n, _, _ in many:
        assert got[n] == "\n".join([f"Day {n}", *story])
    for n, _, _ in alone:  # no page tells the site's lines
        assert got[n] == "\n".join(["Site", f"Day {n}", *story, "Imprint"])
    assert got[30] == "Quite another page." and got[31] == "A third page."


def test_lcs():
    rng = random.Random(2)
    for cells in (10**9, 6):
        pagetext.LCS_CELLS = cells
        for _ in range(300):
            a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            pairs = pagetext.lcs(a, b)
            assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:]))
    pagetext.LCS_CELLS = 200_000_000


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    common = ["the", "of", "house", "tree", "river", "stone", "walk", "talk"]
    data, labels = [], []
    for n in range(600):
        words = [rng.choice(common) + str(rng.randint(0, 40)) for _ in range(60)]
        kind = n % 3
        if kind == 0:
            words[rng.randint(0, 59)] = rng.choice(["idiotic", "idioten"])
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        data.append((n, " ".join(words), kind))
        if n < 450:
            labels.append((n, int(kind != 1), int(kind == 0)))
    labels += [(0, 1, 1), (5000, None, None), (None, 1, 0), (7, None, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, keep int")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, rated).collect()}
    held = [r for r in data if r[0] >= 450]
    assert sum(got[r[0]]["keep"] == (r[2] == 2) for r in held) >= 0.95 * len(held)
    assert all(abs(r["p_poor_up"] + r["p_good"] - r["expected_grade"]) < 1e-9 and r["p_poor_up"] >= r["p_good"] for r in got.values())
    assert quality.classify(docs, rated).count() == docs.count() and quality.classify(empty, rated).count() == 0
    assert quality.classify(docs, rated.where("false")).where("not keep").count() == 0


def test_cumulative_link_brute():
    """Probabilities and slopes by the definition, and a fit that beats all its neighbours."""
    rng = np.random.default_rng(11)
    grades, x, share = rng.integers(0, 3, 40), rng.normal(size=40), rng.random(40) + 0.5
    theta = np.array([-0.7, 0.9])

    def loss(x, theta):
        total = 0.0
        for g, v, s in zip(grades, x, share):
            below = [0.0, 1 / (1 + np.exp(v - theta[0])), 1 / (1 + np.exp(v - theta[1])), 1.0]
            total -= s * np.log(below[g + 1] - below[g])
        return total

    by_x, by_theta, value = quality.slopes(x, grades, theta, share)
    assert np.isclose(value, loss(x, theta))
    for k in range(40):
        step = np.eye(40)[k] * 1e-6
        assert np.isclose(by_x[k], (loss(x + step, theta) - loss(x - step, theta)) / 2e-6, atol=1e-5)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert np.isclose(by_theta[k], (loss(x, theta + step) - loss(x, theta - step)) / 2e-6, atol=1e-5)
    # One feature that tells the grades apart: the fit's own likelihood is near the best of a grid.
    rows = [np.array([1] if g else [2], dtype=np.int32) for g in grades for _ in range(5)]
    many = np.repeat(grades, 5)
    model = quality.fit(rows, many, 4, rounds=600)
    weighted = quality.fit(rows[::5], grades, 4, rounds=600, weight=np.full(40, 5))
    assert np.allclose(model.weights, weighted.weights, atol=1e-3) and np.allclose(model.thresholds, weighted.thresholds, atol=1e-3)
    assert model.score(rows[int(np.argmax(many > 0))]) > model.score(rows[int(np.argmax(many == 0))])


def test_licenses(spark, docs, empty):
    rng = random.Random(12)
    hashes, library = licenses.WordHashes(), licenses.Library.build(licenses.TEMPLATES)

    def brute(text):
        values = licenses.shingles(hashes.of(licenses.WORD.findall(text.lower())))
        return {library.names[k] for k in range(len(library.names)) if len(library.sets[k]) and library.verify(values, k)}

    names = sorted(licenses.TEMPLATES)
    for n in range(120):
        words = licenses.TEMPLATES[names[n % len(names)]].split()
        if n % 2 and len(words) > 30:
            words[rng.randint(0, len(words) - 1)] = "other"
        text = text_of(rng, rng.randint(0, 300)) + " " + " ".join(words) + " " + text_of(rng, rng.randint(0, 300))
        found = library.retrieve(licenses.shingles(hashes.of(licenses.WORD.findall(text.lower()))))
        assert brute(text) <= {library.names[k] for k in found}
        assert n % 2 or names[n % len(names)] in {m[2] for m in licenses.matches(text, library, hashes)}
    assert [t[m[0] : m[1]] for t in ["İİ İ Released under the MIT License. End"] for m in licenses.matches(t, library, hashes)] == ["Released under the MIT License"]
    spans = [(a, a + rng.randint(1, 9), "n", rng.randint(1, 4) / 4) for a in (rng.randint(0, 20) for _ in range(60))]
    assert licenses.outermost(spans) == sorted(x for x in spans if not any(y[0] <= x[0] and x[1] <= y[1] and y[3] > x[3] for y in spans))
    began = time.time()
    assert len(licenses.matches("Released under the MIT License. Other words stand here between. " * 20_000, library, hashes)) == 20_000
    assert time.time() - began < 30
    text = "Zäh. Released under the MIT License. End"
    assert [text[a:b] for a, b, *_ in licenses.matches(text, library, hashes)] == ["Released under the MIT License"]
    assert licenses.scan(docs).where("n_matches > 0").count() == 0 and licenses.scan(empty).count() == 0
