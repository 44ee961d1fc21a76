"""Operators against plain definitions on small tables, with limits low enough that large groups are dealt in blocks."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from talkgrid.llm import decontaminate, fm_index, linededup, mixing, pii, quality, registry, simhash, substrings, toxicity, vectors
from talkgrid.llm.components import components
from talkgrid.llm.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def key(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    wanted = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert key(found.select(*columns).collect()) == key(wanted.fetchall())


def words_of(rng, n, pool=12):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_lines_in_blocks(spark):
    rng = random.Random(5)
    base = [words_of(rng, rng.randrange(3, 12), 30) for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            if rng.random() < 0.7:
                line[rng.randrange(len(line))] = f"x{rng.randrange(40)}"
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    sets = [(d, i, frozenset(x.lower().split())) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    gone = {d: [] for d in range(len(texts))}
    links = dict.fromkeys(range(len(texts)), 0)
    distinct = {s for *_, s in sets}
    for d, i, s in sets:
        links[d] += sum(near(s, o) for o in distinct if o != s)
        if any(near(s, o) for e, j, o in sets if (e, j) < (d, i)):
            gone[d].append(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for limits in ({"group": 4, "hot": 10}, {"group": 3, "hot": 0}, {"group": 7, "hot": 100_000}):
        found = {r.doc_id: r for r in linededup.dedup(docs, buckets=1 << 12, **limits).collect()}
        assert {d: r.n_links for d, r in found.items()} == links
        assert {d: r.text for d, r in found.items()} == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)}


def test_substrings_in_blocks(spark):
    rng = random.Random(8)
    passage = words_of(rng, 45, 9)
    texts = []
    for _ in range(40):
        a = rng.randrange(0, 20)
        texts.append(words_of(rng, rng.randrange(0, 30), 500) + passage[a : a + rng.randrange(15, 30)] + words_of(rng, rng.randrange(0, 30), 3))
    seen, gone = set(), [set() for _ in texts]
    for d, w in enumerate(texts):
        for s in range(len(w) - 19):
            if (win := tuple(w[s : s + 20])) in seen:
                gone[d] |= set(range(s, s + 20))
            seen.add(win)
    want = {d: " ".join(x for i, x in enumerate(w) if i not in gone[d]) for d, w in enumerate(texts)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id bigint, text string")
    for limits in ({"group": 2, "table_bits": 18}, {"table_bits": 17}):
        assert {r.doc_id: r.text for r in substrings.dedup(docs, **limits).collect()} == want


def test_vectors_of_many_lengths(spark, monkeypatch):
    """Vectors of several lengths, wider than the axes too, in small blocks, against all pairs; none of one length meets one of another."""
    monkeypatch.setattr(vectors, "AXIS_WIDTH", 6)
    rng = np.random.default_rng(4)
    rows = []
    for width, n in ((3, 40), (9, 60), (20, 30), (5000, 2)):
        centres = rng.normal(size=(6, width))
        rows += [centres[k % 6] + rng.normal(size=width) * 0.12 for k in range(n)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    unit = [v / np.sqrt(v @ v) for v in rows]
    linked = lambda i, j: i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    want = {i: (sum(linked(i, j) for j in range(len(rows))), c) for i, c in reached(list(range(len(rows))), linked).items()}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    assert max(n for n, _ in want.values()) > 5
    for block in (7, 4096):
        assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.links(df, block=block).collect()} == want


def test_mix_in_more_buckets(spark, duck):
    """More buckets change nothing, and rows without an id are spread by their texts; against SQL."""
    rng = random.Random(6)
    rows = [(i if i % 3 else None, " ".join(words_of(rng, rng.randrange(0, 30), 50)), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert mixing.bucket_digits(10) == 3 and mixing.bucket_digits(10**11) == 6
    own = duck.cursor()
    own.register("mixed_rows", docs.toPandas().astype({"doc_id": "Int64"}))
    columns = "doc_id, size, source_size, target, taken, copies, round(position, 6)"
    want = sorted(own.execute(f"SELECT {columns} FROM ({mixing.sql_for('mixed_rows')})").fetchall(), key=str)
    for bucket_rows in (1 << 16, 0.001):
        found = mixing.assign(docs, bucket_rows=bucket_rows)
        got = found.selectExpr("doc_id", "size", "source_size", "target", "taken", "copies", "round(position, 6)").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    keys = mixing.assign(docs.where("doc_id is null")).select("positions").distinct().count()
    assert keys > 30


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, duck):
    found = {r.doc_id: r for r in registry.QUERIES["op3_simhash"](spark, SF).collect()}
    prints = {d: fingerprint(t) for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert {d: r.fingerprint for d, r in found.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in found.items()} == reached(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def reached(ids, linked):
    low = {i: i for i in ids}
    while True:
        new = {i: min(low[j] for j in ids if linked(i, j) or i == j) for i in ids}
        if new == low:
            return low
        low = new


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(3000)] + [(5000 + k, 5000 + rng.randrange(k)) for k in range(1, 400)]
    rng.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(3001), 0), **dict.fromkeys(range(5000, 5400), 5000)}


def test_simhash_buckets_in_blocks(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)})
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    edges = simhash.link_edges(spark.createDataFrame(rows, "fp bigint, node bigint"), bucket_rows=5).collect()
    near = {frozenset((r.a, r.b)) for r in edges}
    want = reached(list(range(len(prints))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert reached(list(range(len(prints))), lambda a, b: frozenset((a, b)) in near) == want


def test_vectors_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    x[40:] = x[:40] + rng.normal(size=(40, 6)) * 0.35
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.astype(np.float32).tolist())], "vec_id bigint, embedding array<float>")
    for block in (3, 1024):
        found = {r.vec_id: r for r in vectors.links(v, block=block).collect()}
        assert [found[i].n_links for i in range(80)] == (near.sum(axis=1) - 1).tolist()
        assert {i: r.component_id for i, r in found.items()} == reached(list(range(80)), lambda a, b: near[a, b])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, w):
    n = re.sub("[^0-9]", "", w)
    if kind == "ip":
        return all(int(p) <= 255 for p in w.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(n))]
        return 13 <= len(n) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(n) <= 15


def test_base_spans(spark):
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@", ".", "..", "1.2.3.4", "999.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (017) 555-7713", "+4", " ", "-", "é", "😀", "\n", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "00255.0.0.1", "12", "+1((((", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["9" * 30_000 + "a" * 30_000 + "@x.y" + ".z" * 20_000, "1.2.3.4 " * 3000]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for d, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if passes(k, m.group())] if d < 400 else None
        got = [(s.kind, s.begin, s.end) for s in found[d] if s.kind in PATTERNS]
        if want is not None:
            assert got == want, t
    assert [(s.begin, s.end) for s in found[400] if s.kind == "email"] == [(0, 60_000 + 4 + 40_000)]
    assert sum(s.kind == "ip" for s in found[401]) == 3000


def test_secrets_are_added(spark):
    texts = [f'say token = "{hashlib.sha1(str(i).encode()).hexdigest()}" to nobody' for i in range(30)] + [f"it was {1900 + i}/10/{i % 28 + 1} and it cost 1234567.50 for page 1000000{i}" for i in range(30)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert all([(s.kind, s.begin, s.end) for s in found[d]] == [("secret", 13, 53)] for d in range(30))
    assert all(not found[d] for d in range(30, 60))


def test_texts_without_a_hint_have_no_candidates(spark):
    rng = random.Random(9)
    bits = ["dbpassword", "Password", "MOT DE PASSE", ":", "=", " ", "  ", " ", "correcthorse", '"', "7", "12", "Calle", "xCalle", "9Calle", "Mayor", "Hauptstraße", "weg", "Mr", "Dr.", "xMr", "Smith", "smith", "é", ",", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    parts = {"value": pii._VALUE, "named": pii._NAMED, "house": pii._HOUSE}
    for kind, pattern in parts.items():
        both = rows.select(F.col("text").rlike(pii.HINTS[kind]).alias("hint"), F.col("text").rlike(pattern).alias("found"))
        counts = {(r.hint, r.found): r["count"] for r in both.groupBy("hint", "found").count().collect()}
        assert counts.get((False, True), 0) == 0 and counts[True, True] > 10, (kind, counts)


def test_a_span_does_not_depend_on_what_stands_elsewhere(spark):
    alone = ["set dbpassword: correcthorse now", "Mr. Peter Miller spoke", "at 9Calle Mayor 3 today"]
    docs = [(k, t) for k, t in enumerate(alone)] + [(10 + k, f"{t}, says Dr. Smith of 12 Long Street") for k, t in enumerate(alone)] + [(100 + k, f"passphrase = {k}abcdef{k}") for k in range(40)]
    found = {r.doc_id: {(s.begin, s.end) for s in r.spans if s.end <= len(alone[r.doc_id % 10])} for r in pii.find(spark.createDataFrame(docs, "doc_id bigint, text string")).where("doc_id < 20").collect()}
    assert all(found[k] == found[10 + k] for k in range(3)) and found[0] == {(16, 28)}


def test_added_spans_by_kind(spark):
    """Planted data of each kind among plain texts: how much of it is found, and what else."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    made = {
        "email": lambda i: f"{word()}.{i}@mail{i % 9}.example.com",
        "ip": lambda i: f"10.{i}.{i % 7}.{200 - i}",
        "phone": lambda i: f"+1 (555) 555-{1000 + i}",
        "secret": lambda i: f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"',
        "password": lambda i: f"password: {word()}{word()}",
        "name": lambda i: f"{rng.choice(('Mr', 'Mrs', 'Dr.', 'Frau', 'Señora'))} {rng.choice(('Mary', 'Hans', 'José', 'Xu'))} {word().capitalize()}",
        "street": lambda i: rng.choice((f"{i + 10} {word().capitalize()} Street", f"{word().capitalize()}straße {i + 1}", f"Calle {word().capitalize()} {i + 3}")),
    }
    texts, planted = [], {}
    for i in range(40):
        for kind, make in made.items():
            before, what = " ".join(word() for _ in range(rng.randrange(1, 20))) + " ", make(i)
            own = what.split(" ", 2)[2].strip('"') if kind == "secret" else what.split(" ", 1)[1] if kind == "password" else what
            begin = len(before) + what.index(own)
            planted[len(texts)] = (kind, begin, begin + len(own))
            texts.append(before + what + " " + " ".join(word() for _ in range(5)))
    clean = range(len(texts), len(texts) + 300)
    texts += [" ".join(rng.choice((word(), word().capitalize(), str(rng.randrange(3000)), f"{word()}.", "page 12", "Section 3 Of")) for _ in range(30)) for _ in clean]
    found = {r.doc_id: {(s.begin, s.end) for s in r.spans} for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for kind in made:
        hit = [(b, e) in found[d] for d, (k, b, e) in planted.items() if k == kind]
        assert np.mean(hit) >= 0.9, (kind, np.mean(hit))
    assert sum(len(found[d]) for d in clean) <= 3
    assert sum(len(found[d]) for d in planted) <= 1.05 * len(planted)


def test_repeated_rows_keep_their_spans(spark):
    texts = ["mail a.b@c.de now"] * 3 + ["no"]
    docs = spark.createDataFrame([(7, t, "x", "y") for t in texts], "doc_id bigint, text string, _email string, _cand string")
    rows = pii.find(docs).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 1, 1, 1] and {(r._email, r._cand) for r in rows} == {("x", "y")}


@pytest.mark.parametrize("name", ["op1_language", "op4_quality", "op10_toxicity"])
def test_held_out_accuracy(spark, duck, name):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in registry.QUERIES[name](spark, sf).where("held_out").collect()}
    column, source = {"op1_language": ("lang", "documents"), "op4_quality": ("quality", "labels"), "op10_toxicity": ("toxic", "labels")}[name]
    known = duck.execute(f"SELECT doc_id, {column} FROM '{sf}/{source}.parquet' WHERE {column} IS NOT NULL").fetchall()
    right = [(found[d].lang_pred if column == "lang" else found[d].predicted) == y for d, y in known if d in found]
    assert len(right) > 50 and np.mean(right) >= {"lang": 0.98, "quality": 0.93, "toxic": 0.9}[column]


def test_fm_index_finds_all():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = fm_index.FmIndex(text)
    patterns = rng.integers(1, 4, (50, 3))
    sp, ep = index.search(patterns.ravel(), 3 * np.arange(50), 3)
    for p, a, b in zip(patterns, sp, ep):
        want = [i for i in range(398) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_unlabelled_positives_do_not_count_as_negatives():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2)).astype(np.float32)
    toxic = x[:, 0] > 0.5
    known = toxic & (rng.random(3000) < 0.3)
    rows, positive = np.vstack([x[known], x]), np.r_[np.ones(known.sum(), bool), np.zeros(3000, bool)]
    w, bias = toxicity.nnpu(rows, positive, float(toxic.mean()))
    assert ((x @ w + bias > 0) == toxic).mean() > 0.93


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.Network(x[:1000], y[:1000], rng.random(1000) < 0.3)
    p = net.scores(x[1000:])
    assert abs(p.mean() - y[1000:].mean()) < 0.05 and net.temperature > 0


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline(spark, duck):
    docs, sizes = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS) and set(after) <= set(before)
        sizes.append(len(after))
        if name == "SimHash near-dedup":
            sets = {d: shingles(t) for d, t in before.items()}
            low = reached(list(sets), lambda a, b: similar(sets[a], sets[b]))
            assert set(after) == {d for d in before if low[d] == d}
        if name in ("toxicity", "SimHash near-dedup"):
            assert all(after[d] == before[d] for d in after)
    last = corpus_pipeline.mix(spark, docs, SF).collect()
    assert {r.doc_id for r in last} <= set(after) and all(0 <= r.position <= 1 and r.copies == len(r.positions) for r in last)
    assert key((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()) == key((r.doc_id, r.taken) for r in last)


def test_benchmark_in_many_chunks_and_shards(spark, monkeypatch):
    rng = random.Random(12)
    items = [(f"i{k}", " ".join(words_of(rng, rng.randrange(0, 16), 6))) for k in range(40)]
    texts = [" ".join(words_of(rng, rng.randrange(0, 80), 7)) for _ in range(60)] + [items[3][1], None]
    windows = {}
    for k, t in items:
        w = t.split()
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(k)
    want = {}
    for d, t in enumerate(texts):
        w, hit, had = (t or "").split(), set(), set()
        for s in range(len(w)):
            for win, own in windows.items():
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    had |= own
        want[d] = (len(w), len(hit), sorted(had), " ".join(x for i, x in enumerate(w) if i not in hit))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for chunk, shard in ((1 << 20, 8 << 20), (300, 100)):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        found = {r.doc_id: (r.n_words, r.n_hit, r["items"], " ".join((r.text or "").split())) for r in decontaminate.find(docs, bench, chunk_bytes=chunk, cut=True).collect()}
        assert found == want


def test_items_that_share_windows_and_texts_that_repeat_them(spark):
    """Many items with one window, and a document that has it many times: pairs of document and window count once."""
    shared = "one two three four five six seven eight nine ten"
    items = [(f"i{k:04}", f"{shared} x{k}" if k % 2 else shared) for k in range(600)]
    texts = [f"{shared} " * 2000, "nothing of it", f"{shared} x5 and {shared} x7"]
    rows = decontaminate.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")).orderBy("doc_id").collect()
    names = [i for i, _ in items]
    assert [(r.n_words, r.n_hit) for r in rows] == [(20_000, 20_000), (3, 0), (23, 22)]
    assert rows[0]["items"] == names and rows[1]["items"] == [] and rows[2]["items"] == names
    nameless = spark.createDataFrame([(None, "nothing of it"), ("a", "of it")], "item_id string, text string")
    rows = decontaminate.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), nameless).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"]) for r in rows] == [(0, []), (3, ["a"]), (0, [])]
    own = decontaminate.Phrases(["a", "b"], np.array([7, 8, 9, 7, 8, 9], np.uint64), np.array([0, 3, 6]), 3)
    doc, item = own.items_in(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64))
    assert doc.tolist() == [0, 0] and item.tolist() == [0, 1]
