"""Each operator against brute force, an exact round trip or held-out accuracy, with null, empty, long, repeated and odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeloom.llm import bpe, exact_dedup, fingerprints, language_id, near_dedup, packing, quality, queries, token_counts, topics, training_order, url_filter
from pipeloom.llm.vocab import byte_level, default_path, library, word_level

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
R = random.Random(3)
WORDS = ["ab", "the", "naïve", "x1", "日本", "don't", "lorem", "ipsum", "dolor", "sit", "amet", "Straße"]
SAID = lambda n: " ".join(R.choice(WORDS) + str(R.randint(0, 30)) for _ in range(n))
LONG = SAID(40)
TEXTS = [
    None, "", " \n\t ", "a", "Hello  world ", " lead", "tail \n\n x", "<|endoftext|> in <|endoftext|>text", "don't 'll I'LL 's", "日本語 テキスト　混在", "x\x1cy \x1c z", "a" * 700, "ab" * 3000, LONG, LONG, LONG + " more", LONG.upper(),
    LONG.replace(" ", "  "), LONG.replace("lorem", "LOREM"), "é é ́", "\u0085 x \xa0 y", "12 345 6", SAID(900), *[SAID(R.randint(1, 60)) for _ in range(12)],
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with all odd texts, a repeated row, a null id, and columns whose names clash with results."""
    rows = [(i * 7, t, "n", -1.0) for i, t in enumerate(TEXTS)] + [(7 * 13, LONG, "n", -1.0), (None, "no id", "n", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return {(r["doc_id"]): r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize(("name", "make"), [("byte_bpe_50k.json", lambda p: byte_level(p, default_path("byte_bpe_50k.tiktoken"))), ("word_bpe_49k.json", word_level)])
def test_cached_encoding_is_the_library_s(name, make):
    import pyarrow as pa

    from pipeloom.llm.common import flat

    path = default_path(name)
    for _ in range(2):
        ids, each, _, _ = make(path).runs(*flat(pa.array(TEXTS, pa.string())))
        want = library(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])] == [e.ids for e in want]


def test_training_order(spark, docs, empty, tmp_path):
    slots = training_order.feistel(np.arange(1000), 1000, "k")
    assert sorted(slots.tolist()) == list(range(1000)) and slots.tolist() != list(range(1000))
    assert training_order.feistel(np.arange(1), 1, "k").tolist() == [0]
    path, kept = default_path("byte_bpe_50k.json"), docs
    docs.write.parquet(str(tmp_path / "in"))
    kept = spark.read.parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    n = training_order.materialise(kept, folder, path, size=16, slots=50)
    got = training_order.read_shards(spark, folder, 16, 50).collect()
    assert sorted(r["slot"] for r in got) == list(range(n))
    want = {k: library(path).encode(t, add_special_tokens=False).ids + [50256] for k, t in texts(docs).items()}
    want[-1] = want.pop(None)
    for r in got:
        assert np.frombuffer(r["ids"], "<u2").tolist() == want[r["doc_id"]][16 * r["part"] : 16 * r["part"] + 16]
    one = next(f for f in sorted((tmp_path / "out" / "shard=1").iterdir()) if f.name.startswith("part-"))
    before = one.read_bytes()
    one.unlink()
    other = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "shard=0").iterdir()}
    training_order.materialise(kept, folder, path, size=16, slots=50)  # only what is missing is written again
    again = next(f for f in (tmp_path / "out" / "shard=1").iterdir() if f.name.startswith("part-"))
    assert again.read_bytes() == before and other == {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "shard=0").iterdir()}
    assert training_order.materialise(empty, str(tmp_path / "none"), path) == 0


def test_quality(spark, docs, empty):
    good, bad = [SAID(30) for _ in range(60)], [SAID(30).upper().replace(" ", "!! ") for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3] + [(500, 1), (None, 0), (1, None)], "doc_id long, quality int")
    net = quality.fit(rows, labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(rows, net).collect()}
    assert np.mean([got[i] == int(i < 60) for i in range(0, 120, 3)]) > 0.95
    out = quality.score(docs, net, carry=True)
    assert out.count() == docs.count() and out.columns == ["doc_id", "text", "kept", "score", "score_", "predicted"] and {r["score"] for r in out.collect()} == {-1.0, 0.0}
    assert all(0 <= r["score_"] <= 1 for r in out.collect())
    assert quality.fit(rows, labels.limit(0)) is None and quality.score(empty, None).count() == 0
    assert [r["score"] for r in quality.score(docs.limit(1), None).collect()] == [0.5]


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        _, start = quality.chunk_starts(np.array([n]))
        seen = np.zeros(max(n, 1), bool)
        for s in start:
            seen[s : s + quality.CHUNK] = True
        assert seen.all() and (start >= 0).all()


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1?q", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://com/de/a", "http://notorg/", "http://org/", "http://org", "org/", None, "", "http://a.b.org:80/x", "x://y.org#/es/", "http://example.org/es/" + "a" * 5000, "http://x.com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit(3))
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")

    def judged(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        return host, path, rule, verdict

    for most in (100, 0):  # rules broadcast, and shuffled
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, broadcast_rules=most).collect()}
        assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def components(rows, percent=75):
    """Brute force: all pairs."""
    sets = {}
    for k, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in rows:
        for b in rows:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in rows}


@pytest.mark.parametrize("heavy", [64, 3])
def test_near_dedup(spark, docs, empty, heavy, monkeypatch):
    monkeypatch.setattr(near_dedup, "HEAVY", heavy)
    r = random.Random(5)
    base = [f"w{r.randint(0, 900)}" for _ in range(60)]
    more = {}
    for i in range(60):  # a family with more and less alike members
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(60)] = f"z{r.randint(0, 9999)}"
        more[1000 + i] = " ".join(w)
    passage = [f"p{i}" for i in range(50)]
    more |= {2000 + i: " ".join(passage + [f"q{i}_{j}" for j in range(15)]) for i in range(40)}  # a shared passage links nothing
    rows = docs.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(k, t, "") for k, t in more.items()], "doc_id long, text string, kept string"))
    got = near_dedup.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    want = components({k: t for k, t in texts(rows).items() if k is not None})
    for x in got:
        if x["doc_id"] is None:
            assert x["component_id"] is None and not x["kept"]
        else:
            assert (x["n_shingles"], x["component_id"]) == want[x["doc_id"]] and x["kept"] == (x["component_id"] == x["doc_id"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_texts_made_to_collide_are_not_linked(spark):
    """Thue-Morse words collide under powers of one odd number modulo 2**64."""
    t = [bin(i).count("1") & 1 for i in range(1024)]
    said = lambda flip: " ".join("".join("ab"[x ^ flip] for x in t) + str(i) for i in range(9))
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, said(0)), (2, said(1)), (3, said(0))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_links_are_confirmed_on_words():
    x, y = near_dedup.word_shingles("A b c d e f"), near_dedup.word_shingles("a\tb\nc d  e F")
    assert x == y and len(x) == 2 and near_dedup.word_shingles(" \n") == set() and len(near_dedup.word_shingles("a b")) == 1 and near_dedup.word_shingles(None) == set()


def test_heavy_keys_are_not_gathered(spark):
    rows = near_dedup.cut(spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")))
    got = near_dedup.with_group(rows, "k", F.min("v").alias("m"), F.count("*").alias("n"))
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 4000 and got.where("k = 7").select("m", "n").distinct().collect() == [(0, 3000)] and got.where("k <> 7 and (m <> v or n <> 1)").count() == 0


def test_estimate_follows_the_overlap():
    r = np.random.default_rng(1)
    pool = near_dedup.mix(r.integers(0, 1 << 60, 3000, dtype=np.uint64))
    a, b = near_dedup.registers(pool[:2000]), near_dedup.registers(pool[500:2500])
    assert abs(near_dedup.estimate(a[None], b[None], np.array([2000.0]), np.array([2000.0]))[0] - 1500 / 2500) < 0.12


def test_token_counts(docs, empty, monkeypatch):
    path = default_path("byte_bpe_50k.json")
    lib = library(path)
    stored = token_counts.prefix_table(docs, path)
    got = {r["doc_id"]: r for r in token_counts.truncate(stored, 30).collect()}
    known = {r["doc_id"]: r["prefixes"] for r in stored.collect()}
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for k, t in texts(docs).items():
        n = count(t)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(t.encode()), n, n > 30)
        counts = token_counts.unpack_counts(known[k])
        assert len(counts) == len(t) + 1 and counts[-1] == n
        if len(t) < 200:
            assert counts.tolist() == [count(t[:i]) for i in range(len(t) + 1)]
        cut = t[: got[k]["kept_chars"]]
        assert count(cut) == got[k]["kept_tokens"] == counts[len(cut)] <= 30 and all(c > 30 for c in counts[len(cut) + 1 :])
    # questions read the stored counts; nothing is encoded for them
    monkeypatch.setattr(token_counts.PrefixCounts, "piece", None)
    monkeypatch.setattr(token_counts, "_memory", None)
    at = {(r["doc_id"], r["place"]): r["n_tokens"] for r in token_counts.counts_at(stored, [0, 5, 10**6]).collect()}
    for k, t in texts(docs).items():
        assert at[k, 0] == 0 and at[k, 5] == count(t[:5]) and at[k, 10**6] == count(t)
    assert token_counts.truncate(stored, 0).agg(F.max("kept_tokens")).first()[0] == 0
    assert token_counts.truncate(stored.limit(0), 9).count() == 0


def test_prefix_counts_of_odd_texts(empty):
    path = default_path("byte_bpe_50k.json")
    lib, counter = library(path), token_counts.PrefixCounts(path)
    odd = ["x'll y 're\n\nz  \n q", "a  <|endoftext|>  b<|endoftext|>", "!<|endoftext|", "it's\t\t x\n\n\nThe (word) end.\nNext\n\n", *["".join(R.choice(" \n\ta'sl!é日<|") for _ in range(60)) for _ in range(12)]]
    for t in [t[:90] for t in TEXTS if t] + odd:
        assert counter.prefixes(t).tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    assert token_counts.unpack_counts(token_counts.pack_counts(np.array([3, 400, 2]))).tolist() == [0, 3, 400, 2]
    assert token_counts.prefix_table(empty, path).count() == 0


def test_training_order_refuses_other_runs(spark, docs, tmp_path, monkeypatch):
    path, folder = default_path("byte_bpe_50k.json"), str(tmp_path / "out")
    docs.write.parquet(str(tmp_path / "in"))
    kept = spark.read.parquet(str(tmp_path / "in"))
    n = training_order.materialise(kept, folder, path, size=16, slots=50)
    assert training_order.materialise(kept, folder, path, size=16, slots=50) == n  # all there
    for other in ({"seed": "else"}, {"slots": 40}, {"size": 8}):
        with pytest.raises(ValueError, match="another run"):
            training_order.materialise(kept, folder, path, **({"size": 16, "slots": 50} | other))
    with pytest.raises(ValueError, match="another run"):
        training_order.materialise(kept.where("doc_id <> 7"), folder, path, size=16, slots=50)
    os.remove(tmp_path / "out" / "_manifest.json")
    with pytest.raises(ValueError, match="without a manifest"):
        training_order.materialise(kept, folder, path, size=16, slots=50)
    with pytest.raises(ValueError, match="16 bits"):
        training_order.materialise(kept, str(tmp_path / "x"), path, end_id=1 << 16)
    with pytest.raises(TypeError):
        training_order.materialise(kept, str(tmp_path / "y"), path, key="text")


def test_training_order_notices_a_second_reading_with_fewer_rows(spark, tmp_path):
    mark = str(tmp_path / "seen")
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)

    def fewer(batches):  # the second time, some rows are gone
        again = os.path.exists(mark)
        for b in batches:
            yield b.slice(0, b.num_rows - 3) if again else b
        open(mark, "w").close()

    changing = rows.mapInArrow(fewer, "doc_id long, text string")
    with pytest.raises(Exception, match="the input has changed"):
        training_order.materialise(changing, str(tmp_path / "out"), default_path("byte_bpe_50k.json"), size=16, slots=50)


def test_training_order_reads_on_from_any_slot(spark, docs, tmp_path):
    folder, path = str(tmp_path / "on"), default_path("byte_bpe_50k.json")
    n = training_order.materialise(docs, folder, path, size=16, slots=50)
    every = sorted(map(tuple, training_order.read_shards(spark, folder, 16, 50).collect()))
    assert n > 150
    for start in (0, 1, 49, 50, 77, 100, n - 1, n):
        assert sorted(map(tuple, training_order.read_shards(spark, folder, 16, 50, start).collect())) == every[start:]
    os.remove(next((tmp_path / "on" / "shard=0").glob("part-*")))
    assert training_order.read_shards(spark, folder, 16, 50, 77).count() == n - 77  # the first shard isn't needed


def test_fingerprints(spark, docs, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(rows, group=4).collect()}
    known = texts(rows)
    ids = sorted(known)
    for k, after in zip(ids, ids[1:] + ids[:1]):
        assert got[k]["body"] == known[k] and got[k]["next_body"] == known[after] and got[k]["next_fingerprint"] == got[after]["fingerprint"]
    gaps = rows.withColumn("doc_id", F.col("doc_id") * F.col("doc_id") * 1000)
    seen = sorted((r["doc_id"], r["next_body"]) for r in fingerprints.fingerprints(gaps, group=4).collect())
    assert [b for _, b in seen] == [known[k] for k in ids[1:] + ids[:1]]
    assert fingerprints.fingerprints(docs).count() == docs.count() and fingerprints.fingerprints(empty).count() == 0
    long, other = SAID(300), SAID(300)
    pair = spark.createDataFrame([(long, long[: len(long) * 3 // 4] + other[: len(long) // 4], other)], "a string, b string, c string")
    fp = fingerprints.fingerprint
    x = pair.select(fingerprints.likeness(fp(F.col("a")), fp(F.col("b"))).alias("near"), fingerprints.likeness(fp(F.col("a")), fp(F.col("c"))).alias("far"), fingerprints.likeness(fp(F.lit("")), fp(F.lit(""))).alias("same")).first()
    assert abs(x["near"] - 0.75) < 0.1 and x["far"] < 0.1 and x["same"] == 1.0
    # anchors by brute force, over hashes from the same function
    hashed = lambda rows, n: [r["h"] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, " + ", ".join(f"c{k} {'string' if isinstance(rows[0][0], str) else 'long'}" for k in range(n))).orderBy("i").select(F.xxhash64(*[f"c{k}" for k in range(n)]).alias("h")).collect()]
    for t in (long, "one", "two words", "a" * 40 + " 日本語 end"):
        units = [m[0] for m in re.finditer(fingerprints.UNIT, t)]
        h = fingerprints._MARKS[: fingerprints.FRAME] + hashed([(u,) for u in units], 1) + fingerprints._MARKS[fingerprints.FRAME :]
        k, inner = fingerprints.K, fingerprints.S
        order = hashed([tuple(h[i : i + inner]) for i in range(len(h) - inner + 1)], inner)
        last = k - inner
        want = [i for i in range(len(h) - k + 1) if min(order[i], order[i + last]) <= min(order[i + 1 : i + last])]
        found = spark.createDataFrame([(t,)], "t string").select(fp(F.col("t")).alias("x")).first()["x"]
        assert want and [a["place"] + fingerprints.FRAME for a in found] == want
        assert [a["hash"] for a in found] == hashed([tuple(h[i : i + k]) for i in want], k)


def dice(x, y):
    """The likeness of two fingerprints, by hand; steps are known by what they are made of."""
    parts = [{a["hash"] for a in f} | {(a["hash"], b["hash"], b["place"] - a["place"]) for a, b in zip(f, f[1:])} for f in (x, y)]
    return 1.0 if x == y else 2 * len(parts[0] & parts[1]) / (len(parts[0]) + len(parts[1])) if x and y else 0.0


@tables
def test_op6_query(spark):
    """Edited texts, their digests, and both likenesses by brute force."""
    got = sorted(queries.op6_fingerprints(spark, SF).collect(), key=lambda r: r["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    edited = []
    for (k, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 4
        edited.append(t[: len(t) - m] + u[:m])
    fp = fingerprints.fingerprint
    both = {r["i"]: (r["a"], r["b"]) for r in spark.createDataFrame([(i, t, e) for i, ((_, t), e) in enumerate(zip(rows, edited))], "i int, t string, e string").select("i", fp(F.col("t")).alias("a"), fp(F.col("e")).alias("b")).collect()}
    shown = lambda f: " ".join(f"{a['place']}:{a['hash'] & (1 << 64) - 1:X}" for a in f)
    assert len(got) == len(rows)
    for i, (r, (k, t), e) in enumerate(zip(got, rows, edited)):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (k, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(both[i][0]), shown(both[i][1]))
        assert r["near_edited"] == pytest.approx(dice(*both[i]), abs=1e-12) and r["near_next"] == pytest.approx(dice(both[i][0], both[(i + 1) % len(rows)][0]), abs=1e-12)


def test_fingerprints_of_long_texts_are_whole(spark):
    rng = random.Random(4)
    said = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    base, other = said(20_000), said(20_000)
    rows = [("base", base), ("edited", base[:9000] + said(12) + base[9012:]), ("passage", other[:5000] + base[100:150] + other[5050:])]
    fp = fingerprints.fingerprint
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "k string, t string").select("k", fp(F.col("t")).alias("f"))
    got = {r["k"]: r["f"] for r in df.collect()}
    assert all(0.35 < len(f) / 20_000 < 0.45 for f in got.values())  # two of five places
    hashes = {k: {a["hash"] for a in f} for k, f in got.items()}
    # the passage keeps its anchors: they can be matched by place
    moved = {a["hash"]: a["place"] for a in got["passage"]}
    assert {moved[a["hash"]] - a["place"] for a in got["base"] if a["hash"] in moved} == {4900} and len(hashes["base"] & hashes["passage"]) >= 10
    first = df.where("k = 'base'").select(F.col("f").alias("g"))
    near = {r["k"]: r["x"] for r in df.crossJoin(first).select("k", fingerprints.likeness(F.col("f"), F.col("g")).alias("x")).collect()}
    for k, f in got.items():
        assert near[k] == pytest.approx(dice(f, got["base"]), abs=1e-12)
    assert near["base"] == 1 and 0.99 < near["edited"] < 1 and 0 < near["passage"] < 0.01


def test_packing(docs, empty):
    path = default_path("word_bpe_49k.json")
    for shard in (10**6, 2000):
        got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, size=256, shard_tokens=shard).collect()
        parts, sequences = {}, {}
        for r in got:
            parts.setdefault(r["doc_id"], []).append(r)
            sequences.setdefault(r["sequence_id"], []).append(r)
        for k, t in texts(docs).items():
            if k is None:
                continue
            want, at = library(path).encode(t, add_special_tokens=False).ids + [1], 0
            for r in sorted(parts[k], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(want) and np.frombuffer(r["ids"], "<u4").tolist() == want[at : at + r["length"]]
                at += r["length"]
            assert at == len(want)
        for rs in sequences.values():
            at = 0
            for r in sorted(rs, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at == 256 or at & (at - 1) == 0
    assert packing.pack(docs, path).groupBy("doc_tokens").count().count() > 0 and packing.pack(empty, path).count() == 0


def test_packing_ranks_by_bm25(monkeypatch):
    """Which documents follow each other, by plain loops."""
    r = np.random.default_rng(6)
    docs = [np.append(r.integers(2, 40, r.integers(3, 30)), 1) for _ in range(60)]
    each, idf, mean, size = np.array([len(d) for d in docs]), r.random(41).astype(np.float32) + 0.1, 15.0, 64
    got = [k for k, at, *_ in packing.fill_windows(np.concatenate(docs), each, idf, mean, size) if not at]
    counts = [{t: int((d == t).sum()) for t in set(d.tolist())} for d in docs]
    weight = lambda k, t: idf[t] * counts[k][t] * 2.2 / (counts[k][t] + 1.2 * (0.25 + 0.75 * each[k] / mean))
    unused, want, room, seed = set(range(60)), [], 0, None
    while unused:
        if not room:
            seed, room = seed if seed is not None else min(unused), size
        if seed in unused:
            k = seed
        else:
            score = {j: sum(weight(j, t) for t in counts[seed] if t in counts[j]) for j in unused}
            best = max(score.values())
            k = min(j for j in unused if score[j] >= best - 1e-4) if best > 0 else min(unused)
        unused.remove(k)
        want.append(k)
        left = each[k]
        while left >= room:  # what doesn't fit begins the next window, as its seed
            left, room = left - room, size
            seed = k if left else None
            if not left:
                room = 0
                break
        room = room - left if room else 0
    assert got == want


def test_giants_are_packed_in_segments(spark, monkeypatch):
    of, start, each = packing.segments(np.array([5, 300, 1]), 128)
    assert (of.tolist(), start.tolist(), each.tolist()) == ([0, 1, 1, 1, 2], [0, 0, 128, 256, 0], [5, 128, 128, 44, 1])
    path, text = default_path("word_bpe_49k.json"), " ".join(f"w{i % 977}" for i in range(60_000))
    rows = spark.createDataFrame([(1, text), (2, "a b c"), (1, text)], "doc_id long, text string")
    got = packing.pack(rows, path, shard_tokens=20_000).collect()
    want = np.array(library(path).encode(text, add_special_tokens=False).ids + [1], "<u4")
    assert len(want) > 2 * packing.SEGMENT and len({r["sequence_id"] >> 32 for r in got}) > 1
    mine = sorted((r["start"], r["length"], zlib.crc32(r["ids"])) for r in got if r["doc_id"] == 1)
    assert sum(n for _, n, _ in mine) == 2 * len(want) and all(c == zlib.crc32(want[s : s + n].tobytes()) for s, n, c in mine) and {r["doc_tokens"] for r in got if r["doc_id"] == 1} == {len(want)}


def test_packing_puts_like_documents_together():
    ids = np.array([5, 6, 7, 1] + [20, 21, 22, 1] + [5, 6, 8, 1] + [20, 21, 23, 1])
    pieces = packing.fill_windows(ids, np.array([4, 4, 4, 4]), np.ones(30, np.float32), 4.0, 8)
    assert [p[0] for p in pieces] == [0, 2, 1, 3]


def test_packing_deals_like_documents_to_one_shard(spark):
    rng = random.Random(8)
    said = lambda: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)]
    rows = []
    for i in range(300):
        words = said()
        rows += [(i, " ".join(words)), (10_000 + i, " ".join(words[:20] + said()[:6] + words[26:]))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), default_path("word_bpe_49k.json"), size=512, shard_tokens=5000).collect()
    shards = {}
    for r in got:
        shards.setdefault(r["doc_id"], set()).add(r["sequence_id"] >> 32)
    assert len(set().union(*shards.values())) >= 10 and all(len(s) == 1 for s in shards.values())
    assert sum(shards[i] == shards[10_000 + i] for i in range(300)) >= 240


def test_packing_splits_hot_cells():
    got = {c: (first, parts) for c, first, parts in topics.deal({0: 0.3, 1: 0.3, 16: 7.2, 17: 0.4, 32: 0.2})}
    assert got[0] == got[1] == (0, 1) and got[16] == (1, 7) and got[17][0] == got[32][0] == 8


def test_exact_dedup(docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups: dict[str, list] = {}
    for k, t in rows:
        groups.setdefault(plain(t), []).append((-len(t), k is None, k or 0, k))
    got = exact_dedup.exact_groups(docs.repartition(5)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    by = {}
    for k, t in rows:
        by.setdefault(k, (min(groups[plain(t)])[3], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()))
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == by[r["doc_id"]]
    carried = exact_dedup.exact_groups(docs, carry=True)
    assert carried.columns == ["doc_id", "text", "kept", "score", "keep_id", "group_size", "kept_", "text_sha256"] and carried.where("kept_").count() == len(groups) and carried.where("kept = 'n'").count() == len(rows) and exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_over_many_partitions(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = exact_dedup.exact_groups(rows).groupBy("group_size", F.when(F.col("group_size") > 1, F.col("keep_id")).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["group_size"], r["k"], r["n"], r["kept"]) for r in got if r["group_size"] > 1) == [(2666, 1, 2666, 1)]


def test_exact_dedup_of_a_hot_group_with_equal_ids(spark):
    """A third of all rows, equal in text and id, over several partitions; texts come along; only one row stays."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for carry in (False, True):
            got = exact_dedup.exact_groups(rows, carry=carry)
            hot = got.where("doc_id is null")
            assert got.count() == 6000 and got.where("kept").count() == 4001
            assert [tuple(r) for r in hot.groupBy("group_size", "keep_id").agg(F.count("*"), F.sum(F.col("kept").cast("int"))).collect()] == [(2000, None, 2000, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_language_id(spark, docs, empty):
    alphabets = {"p": "abcde", "q": "klmno", "r": "uvwxyz"}
    say = lambda a, n: " ".join("".join(R.choice(a) for _ in range(R.randint(2, 7))) for _ in range(n))
    rows = [(i, say(alphabets[lang], R.randint(1, 40)), lang) for i, lang in enumerate(R.choice("pqr") for _ in range(300))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r for r in language_id.identify(frame, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 3 == 0]) > 0.97 and not any(got[i]["rejected"] for i, *_ in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $%"), (4, "日本語" * 200)], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.identify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", True) and out[4][1]
    assert language_id.identify(docs, model, carry=True).count() == docs.count() and language_id.identify(empty, model).count() == 0
    none = language_id.fit(frame.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(frame, none).collect()} == {"und"}


def test_language_id_by_brute_force(spark):
    """Vectors, idf and nearest centroid by plain loops, for texts with and without letters."""
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 6)], "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    odd = [None, "", "\u00b2 \u00bd \u2167 12", "Der Hund", "THE dog!", "x", "日本", "\u00df"]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(odd):
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        raw = [0x20, *[b | 0x20 if 0x41 <= b < 0x5B else b if 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in t.encode()], 0x20]
        x = np.zeros(language_id.DIMENSIONS)
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if b != 0x20:
                x[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
        x = np.sqrt(x) * model.idf
        near = model.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        assert got[i]["lang_pred"] == model.languages[int(near.argmax())] and got[i]["score"] == pytest.approx(max(0, near.max()), abs=1e-5)


def test_language_sample_is_bounded(spark):
    rows = spark.range(900).select(F.lit(5).alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    model = language_id.fit(rows, per_language=20, centroids=30)
    assert 0 < len(model.languages) <= 20


@tables
def test_held_out_accuracy_on_the_tables(spark):
    sf = SF.replace("0.001", "0.01")  # enough held-out labels to count
    got = queries.op9_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0
    scored = queries.op2_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality in (0, 1)")
    assert scored.where("predicted = quality").count() >= 0.9 * scored.count() > 0


def test_quality_by_brute_force():
    """The probability of a text by plain loops over chunks, places and filters."""
    net, r = quality.ByteConvNet.start(3), np.random.default_rng(2)
    net.bias, net.hidden_bias, net.out_bias = (r.standard_normal(x.shape).astype(np.float32) for x in (net.bias, net.hidden_bias, net.out_bias))
    said = [b"", b"abc", bytes(r.integers(1, 256, 1100, dtype=np.uint8))]
    got = net.score(np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)]))
    for t, p in zip(said, got):
        n = 1 if len(t) <= quality.CHUNK else -(-(len(t) - quality.CHUNK) // quality.STEP) + 1
        total = 0.0
        for k in range(n):
            start = min(k * quality.STEP, max(len(t) - quality.CHUNK, 0))
            c = t[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            seen = [net.embed[list(c[i : i + quality.WINDOW])].ravel() @ net.filters for i in range(0, quality.CHUNK - quality.WINDOW + 1, quality.STRIDE)]
            h = np.maximum(np.max(seen, axis=0) + net.bias, 0)
            total += float(np.maximum(h @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias[0])
        assert p == pytest.approx(1 / (1 + np.exp(-total / n)), abs=1e-4)


def test_quality_sample_is_bounded(spark):
    rows = spark.range(400).select(F.lit(1).alias("doc_id"), F.concat(F.lit("good "), F.col("id")).alias("text"))  # one id, many texts
    labels = spark.createDataFrame([(1, 1)] * 50, "doc_id long, quality int")
    seen = []
    keep = quality.ByteConvNet.learn
    quality.ByteConvNet.learn = lambda self, x, y, w, **k: seen.append(len(x))
    try:
        quality.fit(rows, labels, sample=30)
        quality.fit(rows, labels, sample=30, sample_bytes=40)
    finally:
        quality.ByteConvNet.learn = keep
    assert seen[0] == 30 and 1 <= seen[1] <= 6


def test_bpe(spark, docs, empty):
    path = default_path("byte_bpe_50k.json")
    lib = library(path)
    for kw in ({}, {"spread": 40, "part": 16}):  # whole texts, and texts in parts
        got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path, **kw), path).collect()}
        assert len(got) == len(texts(docs))
        for k, t in texts(docs).items():
            want = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(got[k]["ids"], "<u4").tolist() == want and got[k]["decoded"] == lib.decode(want, skip_special_tokens=False) == t
        assert bpe.encode(docs, path, **kw).count() == docs.count() and bpe.encode(empty, path, **kw).count() == 0
    own = bpe.TreeEncoder(path)
    for _ in range(60):
        s = "".join(R.choice("theaninorst") for _ in range(R.randint(1, 900)))
        assert own.run(s.encode(), leaf=R.choice([2, 7, 48])) == lib.encode(s, add_special_tokens=False).ids


def test_halves_are_encoded_by_several_tasks(spark, monkeypatch):
    path = default_path("byte_bpe_50k.json")
    parts = list(bpe.encoder(path).parts(np.frombuffer(b"a" * 200_001, np.uint8)))
    assert [g for g, _, _ in parts] == [False] + [True] * 7 and max(len(p[0]) for _, _, p in parts) <= bpe.PART
    rows = spark.createDataFrame([(1, "a" * 200_001 + "!" * 70_000)], "doc_id long, text string")
    plan = bpe.encode(rows, path)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 3 and "REPARTITION_BY_NUM" in plan
    joined = []
    own = bpe.TreeEncoder(path)
    monkeypatch.setattr(own.merges, "plain", lambda d, f=own.merges.plain: joined.append(len(d)) or f(d))
    own.join_all([own.run(b"ab" * 8000), own.run(b"ba" * 8000)])
    assert len(joined) >= 2 and sum(joined) < 40_000 * 8  # leaves and windows, never a whole run again


@pytest.mark.parametrize("name", ["a" * 1_100_000, " ".join(f"w{i % 5000}x" for i in range(170_000)), "日本" * 200_000])
def test_texts_over_a_megabyte(spark, name):
    """All operators on a very long text beside a short one."""
    rows = spark.createDataFrame([(1, name), (2, "short text of a few words"), (3, name + " ")], "doc_id long, text string")
    path, word = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
    want = library(path).encode(name, add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in bpe.encode(rows, path).collect()}
    assert np.frombuffer(got[1]["ids"], "<u4").tolist() == want
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.truncate(token_counts.prefix_table(rows, path), 512).collect()}[1] == len(want)
    assert {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_groups(rows).collect()} == {1: 2, 2: 1, 3: 2}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows).collect()} == {1: 1, 2: 2, 3: 1}
    f = {r["doc_id"]: r for r in fingerprints.fingerprints(rows).collect()}
    assert f[1]["fingerprint"] == f[3]["fingerprint"] != f[2]["fingerprint"] and f[1]["next_body"] == "short text of a few words"
    assert quality.score(rows, quality.ByteConvNet.start()).count() == 3
    assert language_id.identify(rows, language_id.fit(rows.withColumn("lang", F.lit("x")))).count() == 3
    pieces = packing.pack(rows, word).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in pieces) and {r["doc_id"]: r["m"] for r in pieces}[1] == len(library(word).encode(name, add_special_tokens=False).ids) + 1


def test_keys_that_are_no_whole_numbers_are_refused(spark):
    rows = spark.createDataFrame([("x", "text")], "doc_id string, text string")
    for f in (near_dedup.near_duplicates, exact_dedup.exact_groups, fingerprints.fingerprints):
        with pytest.raises(TypeError, match="whole number"):
            f(rows)


def test_crc_column(spark):
    from pipeloom.llm.common import crc_mod

    got = spark.range(50).select("id", crc_mod("id", 5).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark_rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == p.COLUMNS, name
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "exact_dedup":
            assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in spark_rows.values()})
        if name == "near_dedup":
            assert set(kept) == {k for k, (_, root) in components({k: t or "" for k, t in spark_rows.items()}).items() if root == k}


@tables
def test_pipeline_from_end_to_end(spark):
    """run() by its stages, each written and read again; the packed pieces hold exactly the documents that stay."""
    import corpus_pipeline as p

    got = p.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(rows, docs.schema)
    path, parts, sequences = default_path("word_bpe_49k.json"), {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(parts) == set(left)
    for k, t in left.items():
        want, at = np.array(library(path).encode(t, add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(parts[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(want)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_pipeline_stages_of_empty_tables_and_more_columns(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, SAID(30), "en", "s", 9, "own", 0.5) for i in range(30)] + [(None, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars int, rejected string, kept double")
    docs.select("doc_id", F.lit(1).alias("quality")).where("doc_id is not null").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("rejected = 'own'").count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert p.stage_packing(spark, docs.limit(0), str(tmp_path)).count() == 0
