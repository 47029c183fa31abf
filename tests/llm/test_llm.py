"""The operators against brute force, on rows that are awkward in every column, and on none."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import (
    bpe,
    chat,
    fingerprints,
    jaccard,
    mixing,
    neighbours,
    quality,
    queries,
    secrets,
    sharding,
    toxicity,
)
from millrace.llm import texts as T
from millrace.llm.components import components
from millrace.queries.registry import QUERIES
from tests.llm.conftest import texts, words

NAMES = [name for name in QUERIES if re.match(r"op\d+_", name)]
SAMPLE = "/root/testdata/sf0.01"


def digest(text: str | bytes) -> str:
    return sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def grams(text: str | None) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


def test_all_operators():
    assert sorted({int(name[2:].split("_")[0]) for name in NAMES}) == list(range(1, 14))


@pytest.mark.parametrize("name", [*NAMES, "pipeline"])
def test_no_rows(spark, nothing, name):
    rows = QUERIES[name](spark, nothing).collect()
    assert len(rows) == (1 if name.startswith("op9") else 0)


@pytest.mark.parametrize("name", [n for n in NAMES if not re.match("op([69]|11|12)_", n)])
def test_every_document_once(spark, tables, name):
    rows = QUERIES[name](spark, tables).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in texts())


def test_words_and_shingles():
    rows = ["a b  c\td e f", None, "", " x ", "eins zwei", "long" * 1000 + " b"]
    for _, end, data, offsets in T.slices(pa.array(rows)):
        starts, ends, first = T.spans(data, offsets, T.WHITESPACE)
        found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
        assert [found[first[k] : first[k + 1]] for k in range(end)] == [(t or "").split() for t in rows]
        hashes = T.hash_spans(data, starts, ends)
        assert len(set(hashes.tolist())) == len(set(found))
    assert [len(s) for s in T.shingle_sets(pa.array(rows))] == [2, 0, 0, 1, 1, 1]


def test_fingerprints(spark, tables):
    rows = QUERIES["op1_fingerprints"](spark, tables).collect()
    given = sorted(((t or "") for i, t, _ in texts() if i is None)), sorted((i, t or "") for i, t, _ in texts() if i is not None)
    order = [(None, t) for t in given[0]] + given[1]
    edited = Counter()
    near = {}
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        part = len(t) // 4
        changed = t[: len(t) - part] + after[:part]
        edited[i, len(t), digest(changed)] += 1
        a, b = grams(t), grams(changed)
        near[i] = len(a & b) / len(a | b) if a | b else 1.0
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == edited
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert all(abs(r["near_edited"] - near[r["doc_id"]]) < 0.2 for r in rows if r["doc_id"] not in (None, 11))
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] != by_id[2]["fingerprint"]
    assert by_id[0]["near_next"] == 1.0 and by_id[4]["fingerprint"] == ""


def test_sketch_containment_and_merge(spark):
    long, part = words(3, 20_000), words(3, 20_000)[5_000:7_000]
    df = spark.createDataFrame([(" ".join(long), " ".join(part))], "a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    made = df.select(a.alias("a"), b.alias("b"))
    row = made.select(
        fingerprints.containment(F.col("b"), F.col("a")).alias("inside"),
        fingerprints.likeness(F.col("a"), F.col("b")).alias("like"),
        (fingerprints.merge(F.col("a"), F.col("b"))["hashes"] == F.col("a.hashes")).alias("union"),
        F.size("a.hashes").alias("kept"),
    ).first()
    assert row["inside"] == 1.0 and abs(row["like"] - 0.1) < 0.02 and row["union"]
    assert abs(row["kept"] - 20_000 / fingerprints.SCALE) < 200


@pytest.mark.parametrize("name,label,folds,out,least,accuracy", [
    ("op2_quality_ranking", "quality", 3, 1, 0.5, 0.97),
    ("op8_toxicity_machine", "toxic", 4, 2, 0.3, 0.9),
])
def test_held_out_accuracy(spark, name, label, folds, out, least, accuracy):
    rows = QUERIES[name](spark, SAMPLE).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least)
    tried = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in tried]) >= accuracy


def test_pair_model_and_one_class():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(400, 3))
    better = rows @ [1.0, -2.0, 0.0] + draw.normal(size=400) * 0.1 > 0.5
    model = quality.fit(rows, better)
    assert np.mean((model.scores(rows) >= 0.5) == better) > 0.95
    assert (quality.fit(rows, np.ones(400, dtype=bool)).scores(rows) == 0.5).all()


def test_every_label_trains_the_pair_model(spark, monkeypatch):
    """Blocks see all rows, the rare ones several times, and the cut is that of all scores."""
    monkeypatch.setattr(quality, "BLOCK", 64, raising=False)
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(["fine", "words", "here", "||||", "####"], 30)) for _ in range(600)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (6, "another text"), (None, "none")]
    label = [int(sum(c in "|#" for c in t) < 36) for t in texts]
    assert 3 < sum(label) < 100
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([*enumerate(label), (None, 1), (900, 1)], "doc_id long, quality int")
    model = quality.train(documents, labels)
    trained = [(t, label[k]) for k, t in dict.fromkeys(docs) if k is not None]
    reached = np.sort(quality.measures(pa.array([t for t, _ in trained])) @ model.weights)
    worse = sum(not x for _, x in trained)
    assert model.threshold == pytest.approx((reached[worse - 1] + reached[worse]) / 2, abs=1e-9)
    scores = model.scores(quality.measures(pa.array(texts)))
    assert np.mean((scores >= 0.5) == np.array(label)) > 0.95
    rows = spark.createDataFrame([(k, x, [float(k)] * quality.MEASURES) for k, x in enumerate(label)], "doc_id long, label int, x array<double>")
    blocks = quality._blocks(rows, sum(label), len(label) - sum(label), quality.RIVALS).collect()
    held = [[int(v) for b in blocks for v in np.frombuffer(b[side])[:: quality.MEASURES]] for side in ("good", "bad")]
    assert set(held[0]) == {k for k, x in enumerate(label) if x} and sorted(held[1]) == [k for k, x in enumerate(label) if not x]
    assert all(len(b["good"]) and len(b["bad"]) for b in blocks)


def test_factorization_machine_learns_a_pair():
    # Neither "aa" nor "bb" alone is toxic; together they are.
    draw = np.random.default_rng(2)
    rows = [[w for w in ("aa", "bb", "cc", "dd") if draw.random() < 0.5] for _ in range(600)]
    label = np.array([float("aa" in r and "bb" in r) for r in rows])
    # Another word in each, as equal rows count once.
    batch = pa.array([" ".join([*r, f"{'xyz'[k % 3]}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}"]) for k, r in enumerate(rows)])
    found, first = [], [0]
    for cells, begin in toxicity.cells(batch):
        for k in range(len(begin) - 1):
            found.append(np.unique(cells[begin[k] : begin[k + 1]]))
            first.append(first[-1] + len(found[-1]))
    model = toxicity.fit(np.concatenate(found), np.array(first), label)
    scores = model.scores(pa.array(["aa bb", "aa cc", "bb dd", "", None]))
    assert scores[0] > 0.5 > max(scores[1:])
    assert (toxicity.fit(np.concatenate(found), np.array(first), 0 * label).scores(batch) < 1e-9).all()


@pytest.mark.parametrize("folder", ["tables", SAMPLE])
def test_mixing(spark, request, folder):
    where = request.getfixturevalue(folder) if folder == "tables" else folder
    rows = [r.asDict() for r in QUERIES["op3_entropy_mixing"](spark, where).collect()]
    assert Counter(map(repr, rows)) == Counter(
        repr(r.asDict()) for r in QUERIES["op3_entropy_mixing"](spark, where).collect()
    )
    docs = spark.read.parquet(f"{where}/documents.parquet").collect()
    size, source = Counter(), defaultdict(set)
    for d in docs:
        size[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        source[d["doc_id"]].add(d["source"])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:  # fill up, source by source
        free = [s for s in names if s not in full]
        target.update({s: left * weight[s] / sum(weight[x] for x in free) for s in free})
        over = [s for s in free if target[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s], left = 2.0 * size[s], left - 2 * size[s]
        full |= set(over)
    taken, biggest = Counter(), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 < r["rate"] <= 2
        (of,) = source[r["doc_id"]] if len(source[r["doc_id"]]) == 1 else (next(s for s in source[r["doc_id"]] if size[s] == r["source_size"]),)
        assert r["source_size"] == size[of] and r["target"] == pytest.approx(target[of])
        taken[of] += r["taken"]
        biggest[of] = max(biggest[of], r["size"])
    for s in names:
        slack = 0.02 * target[s] if folder != "tables" else biggest[s]
        assert abs(taken[s] - target[s]) <= slack


def test_newton_meets_targets(spark):
    cells = spark.createDataFrame(
        [(s, size, 5 + size % 3) for s in ("a", None) for size in range(0, 400, 7)], "source string, size long, n long"
    )
    wanted = mixing.targets(cells, weights=(1.0, 3.0), total=1.1)
    solved = {r["source"]: r for r in mixing.multipliers(cells, wanted).collect()}
    for s, r in solved.items():
        got = sum(c["n"] * c["size"] * min(2, np.exp(r["tilt"] * c["size"])) for c in cells.collect() if c["source"] == s)
        assert got == pytest.approx(r["target"], rel=1e-6)


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    owner = sharding.lookup_table(names, 101)
    assert sorted(Counter(owner.tolist()).values()) == [14, 14, 14, 14, 15, 15, 15]
    # By the definition: each shard, in turn, claims the first free slot of its order.
    free, order = set(range(101)), []
    for n in names:
        start, step = (int(sha256(f"{w}:{n}".encode()).hexdigest()[:15], 16) for w in ("start", "stride"))
        order.append([(start % 101 + j * (step % 100 + 1)) % 101 for j in range(101)])
    want = np.full(101, -1)
    for turn in range(101):
        slot = next(s for s in order[turn % 7] if s in free)
        free.remove(slot)
        want[slot] = turn % 7
    assert (owner == want).all()
    fewer = sharding.lookup_table(names[:-1], 101)
    assert np.mean((owner != fewer)[owner != 6]) < 0.2
    for bad in ((names, 100), ([], 101), (["a", "a"], 101), (names, 5)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def spans_by_hand(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    assign = r"""(?i)(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    for rank, (kind, pattern, good) in enumerate([
        ("assign", assign, lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return sorted(out)


def test_secret_spans(spark, tables):
    rows = QUERIES["op5_secret_ledger"](spark, tables).collect()
    want = Counter()
    for i, t, _ in texts():
        found = spans_by_hand(t or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        kinds = Counter(kind for _, _, kind, _ in found)
        want[i, kinds["assign"], kinds["access"], kinds["hex"], digest(joined), joined] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in rows) == want
    assert max(len(spans_by_hand(t or "")) for _, t, _ in texts()) >= 3


def test_ledger_scans_only_what_is_new(spark, docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    blobs = len({t or "" for _, t, _ in texts()})
    assert secrets.scan(docs.limit(0), ledger) == 0
    assert secrets.scan(docs, ledger, secrets.BASE) == blobs
    assert secrets.scan(docs, ledger, secrets.BASE) == 0
    fresh = spark.createDataFrame([(1, "password: hunter22"), (2, None)], "doc_id long, text string")
    assert secrets.scan(fresh, ledger, secrets.BASE) == 1
    newer = (*secrets.BASE[:2], secrets.Rule("hex", 2, "[0-9a-f]{30,}"))
    assert secrets.scan(docs, ledger, newer) == blobs
    found = secrets.findings(fresh, ledger, newer).orderBy("doc_id").collect()
    assert [tuple(f) for f in found[0]["found"]] == [("assign", 0, 18)] and found[1]["found"] == []
    short = spark.createDataFrame([(1, "0" * 26)], "doc_id long, text string")
    secrets.scan(short, ledger, secrets.RULES)
    assert len(secrets.findings(short, ledger, secrets.RULES).first()["found"]) == 1
    secrets.scan(short, ledger, newer)
    assert secrets.findings(short, ledger, newer).first()["found"] == []


def test_redaction(spark):
    text = 'é token = "abcdef0123456789abcdef0123456789" tail'
    df = spark.createDataFrame([(text,), ("none",)], "text string")
    found = F.flatten(F.array(*(secrets.spans(F.col("text"), r) for r in secrets.BASE)))
    got = [r[0] for r in df.select(secrets.redacted(F.col("text"), found)).collect()]
    assert got == ['é [SECRET]" tail', "none"]


@pytest.mark.parametrize("shard", [neighbours.SHARD, 40])
def test_neighbours(spark, tables, shard):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    if shard == neighbours.SHARD:
        rows = QUERIES["op6_projected_neighbours"](spark, tables).collect()
    else:
        rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard=shard, sample=64).collect()
    good = {
        r["vec_id"]: np.array(r["embedding"], dtype=float)
        for r in df.collect()
        if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]
        and np.isfinite(r["embedding"]).all() and any(r["embedding"]) and len(r["embedding"]) == 6
    }
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        assert r["score"] == pytest.approx(float(good[r["query_id"]] @ good[r["vec_id"]]), abs=1e-12)
        got[r["query_id"]].append(r["vec_id"])
    asked = [i for i in good if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hits = exact = 0
    for i in asked:
        # Scores as sums of the same order tie exactly.
        score = {j: float(np.einsum("i,i->", good[i], v)) for j, v in good.items() if j != i}
        best = sorted(score, key=lambda j: (-score[j], j))[:20]
        hits += len(set(best) & set(got[i]))
        exact += best == got[i]
    assert hits >= 0.95 * 20 * len(asked) and exact >= 0.8 * len(asked)


def test_neighbours_of_repeated_rows(spark):
    draw = np.random.default_rng(3)
    vectors = [(k, draw.normal(size=6).tolist()) for k in range(60)]
    near = [(100 + k, (np.array(vectors[0][1]) * (4 + k)).tolist()) for k in range(4)]
    rows = spark.createDataFrame([*vectors, *near * 40], "vec_id long, embedding array<double>")
    for sample in (64, neighbours.SAMPLE):
        found = neighbours.nearest(rows, F.col("vec_id") == 0, sample=sample).collect()
        score = {i: float(np.dot(vectors[0][1], v)) for i, v in [*vectors[1:], *near]}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert len(set(best) & {r["vec_id"] for r in found}) >= 19


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


@pytest.mark.parametrize("pairs", [jaccard.PAIRS, 2])
def test_jaccard(spark, tables, pairs, monkeypatch):
    """Both ways, by listed pairs and by blocks, give all links."""
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 3)
    base = words(40, 200)
    given = [(i, t) for i, t, _ in texts()]
    for k in range(12):
        given.append((1000 + k, " ".join([*base[: 10 * k], f"edit{k}", *base[10 * k + 1 :]])))
    for k in range(6):
        given.append((2000 + k, " ".join([*base[:100], *words(50 + k, 100)])))
    df = spark.createDataFrame(given, "doc_id long, text string")
    rows = [r for r in jaccard.jaccard_groups(df).collect()]
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in given)
    sets = [(i, t or "", grams(t)) for i, t in given]
    known = {t: min((i for i, u, _ in sets if u == t and i is not None), default=None) for _, t, _ in sets}

    def linked(a, b):
        if a[1] == b[1]:
            return True
        return known[a[1]] is not None and known[b[1]] is not None and bool(a[2] | b[2]) and len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])

    number = [sum(linked(a, b) for b in sets) - 1 for a in sets]
    reached = list(range(len(sets)))
    for _ in sets:
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if linked(a, b):
                    reached[x] = reached[y] = min(reached[x], reached[y])
    group = {r: min((sets[x][0] for x in range(len(sets)) if reached[x] == r and sets[x][0] is not None), default=None) for r in reached}
    want = Counter((a[0], group[reached[x]], number[x]) for x, a in enumerate(sets))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == want


def test_banding_reaches_recall():
    bands, rows = jaccard.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jaccard.MOST


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_chat(spark, tables):
    out = QUERIES["op9_chat_formatting"](spark, tables).collect()
    given = defaultdict(list)
    for r in spark.read.parquet(f"{tables}/conversations.parquet").collect():
        given[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    edge = "</s>[INST] ok [/INST]"
    given[-7] = [(True, 0, "user", edge), (True, 1, "assistant", edge)]
    want = {}
    for i, turns in given.items():
        turns = sorted(turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        want[i] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learned), digest(learned))
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out} == want


def test_chat_escapes_every_control(spark):
    rows = [c + "\\" + d for c in chat.CONTROLS for d in chat.CONTROLS] + ["\\", "\\\\", "<\\|im_end|>", "<" * 5, ""]
    df = spark.createDataFrame([(t,) for t in rows], "text string").select("text", chat.escape(F.col("text")).alias("safe"))
    for r in df.select("*", chat.unescape(F.col("safe")).alias("back")).collect():
        assert r["back"] == r["text"] and not any(c in r["safe"] for c in chat.CONTROLS)


def test_chat_layouts(spark):
    records = [
        (1, {"prompt": "p", "completion": "c", }),
        (2, {"instruction": "i", "input": "n", "output": "o"}),
        (3, {"output": "o", "instruction": "i"}),
        (4, {"messages": [{"role": "user", "content": "m"}, {"content": "a", "role": "assistant"}]}),
        (5, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}),
        (6, {"unknown": 1}),
        (9, {"instruction": "a", "input": None, "output": "c"}),
        (10, {"id": 4, "messages": [{"role": "user", "content": None, "name": "x"}, {"role": "assistant"}], "meta": {"messages": 1}}),
        (11, {"messages": []}), (12, {"messages": None}), (13, {"prompt": "p", "completion": ["c"]}),
        (14, {"messages": [{"role": "user", "content": [{"type": "text"}]}]}), (15, {"messages": "m"}),
        (16, {"prompt": "p", "prompt_id": "z", "messages": [{"role": "user", "content": "m"}]}),
        (17, {"conversations": [None, {"from": "bot", "value": "v"}]}), (18, {"prompt": "p", "completion": None}),
        (19, {}), (20, [1]), (21, "text"),
    ]
    rows = [(i, json.dumps(x)) for i, x in records] + [(7, "{broken"), (8, None)]
    got = chat.turns_of_records(spark.createDataFrame(rows, "id long, payload string"), "id", "payload").collect()
    turns = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in got}
    assert turns == {
        1: [("user", "p"), ("assistant", "c")],
        2: [("system", "i"), ("user", "n"), ("assistant", "o")],
        3: [("user", "i"), ("assistant", "o")],
        4: [("user", "m"), ("assistant", "a")],
        5: [("user", "h"), ("assistant", "g")],
        6: None, 7: None, 8: None, 13: None, 14: None, 15: None, 19: None, 20: None, 21: None,
        9: [("system", "a"), ("user", None), ("assistant", "c")],
        10: [("user", None), ("assistant", None)], 11: [], 12: [], 16: [("user", "m")],
        17: [(None, None), ("assistant", "v")], 18: [("user", "p"), ("assistant", None)],
    }
    # The same fields in another order, or with more beside them, have the same fingerprint.
    prints = {r["conv_id"]: r["fingerprint"] for r in got}
    assert prints[4] == prints[10] == prints[11] == prints[12] != prints[16] and prints[7] is prints[20] is None
    assert {r["conv_id"]: r["layout"] for r in got}[5] == "from and value"
    other = spark.createDataFrame([(1, 0, "user", "x", 2)], "conversation_id long, message_index long, author string, content string, more int")
    assert chat.turns_of_rows(other).columns == ["conv_id", "turn", "role", "text"]
    for wrong in (spark.range(1), other.withColumn("content", F.lit(1)), other.withColumn("message_index", F.lit("x"))):
        with pytest.raises(ValueError):
            chat.turns_of_rows(wrong)


def test_records_give_back_every_turn(spark):
    turns = [(k % 9, k // 9, ["user", "assistant", "system", "human", "", None][(k * k + k // 9) % 6], f"t{k}\\ {chr(0x1F600)}") for k in range(45)]
    turns += [(20, 0, "user", "q"), (20, 1, "assistant", None), (21, 0, "system", ""), (21, 1, "user", "u"), (21, 2, "assistant", "a")]
    turns += [(None, None, None, None), (None, 1, "user", "x"), (30, 0, "user", "same"), (30, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = defaultdict(list)
    for r in queries.in_many_layouts(df).orderBy("conv_id", "turn").collect():
        back[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    given = defaultdict(list)
    for i, n, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        given[i].append((r or "", t or ""))
    assert back == given


def test_time_of_many_matches_and_turns(spark):
    began = time.time()
    for n in (8_000, 32_000):
        text = " é ".join(f"token=abcdef{k}" for k in range(n))
        df = spark.createDataFrame([(text,)], "text string").withColumn("found", secrets.spans(F.col("text"), secrets.BASE[0]))
        row = df.select("found", secrets.redacted(F.col("text"), F.col("found")).alias("clean")).first()
        assert [(f["start"], f["end"]) for f in row["found"]] == [m.span() for m in re.finditer(r"token=\w+", text)]
        assert row["clean"] == re.sub(r"token=\w+", "[SECRET]", text)
    turns = [(1, k, "assistant" if k % 2 else "user", f"é text {k}") for k in range(16_000)]
    out = chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    read = out.select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [tuple(t) for t in read["t"]] == [t[2:] for t in turns] and read["l"] == [t[3] for t in turns if t[2] == "assistant"]
    assert time.time() - began < 60


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.read_ranks(path, public_tokenizers.PATTERN)
    import base64

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(path, "rb"))}
    return vocabulary, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_byte_bpe(spark, tables, encoding):
    _, whole = encoding
    rows = QUERIES["op10_byte_bpe"](spark, tables).collect()
    want = Counter()
    for i, t, _ in texts():
        ids = whole.encode_ordinary(t or "")
        want[i, len(ids), digest(",".join(map(str, ids))), digest((t or "").encode())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_bpe_like_the_library(encoding):
    import random

    vocabulary, whole = encoding
    draw = random.Random(3)
    odd = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x85, 0xA0, 0x1F600, 0x4E2D, 0xFEFF, 0x0660, 0x2167]]
    given = ["".join(draw.choices(odd, k=draw.randint(0, 50))) for _ in range(500)]
    given += ["".join(draw.choices(" \n\t''''sabtrevlmd\x1c 1$", k=draw.randint(0, 40))) for _ in range(1500)]
    given += ["a" * 5000, "ab" * 700, " " * 3000, "é" * 400, "".join(draw.choices("etaoin", k=250)), "", None]
    flat, counts = vocabulary.encode_texts(pa.array(given))
    ends = np.cumsum(counts)
    got = [flat[end - n : end].tolist() for end, n in zip(ends, counts, strict=True)]
    assert got == [whole.encode_ordinary(t or "") for t in given]
    lists = pa.array([*got, None], pa.list_(pa.int32()))
    assert bpe.decode_lists(vocabulary, lists).to_pylist() == [*((t or "").encode() for t in given), None]
    for bad in ([[99_999_999]], [[-1]], [[None]]):
        with pytest.raises(ValueError):
            bpe.decode_lists(vocabulary, pa.array(bad, pa.list_(pa.int32())))


def test_pipeline_by_stages(spark, tmp_path):
    """Each stage against what its rule says of the rows that it got."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SAMPLE)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    good, distinct, clean, mixed, tokens = seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.97
    by_text = {r["doc_id"]: grams(r["text"]) for r in distinct}
    holders = defaultdict(list)
    for i, found in by_text.items():
        for g in found:
            holders[g].append(i)
    for i, found in by_text.items():
        met = Counter(j for g in found for j in holders[g] if j != i)
        assert all(n < 0.8 * (len(found) + len(by_text[j]) - n) for j, n in met.items())
    assert Counter(r["doc_id"] for r in clean) == Counter(r["doc_id"] for r in distinct)
    assert any("[SECRET]" in r["text"] for r in clean)
    assert not any(spans_by_hand(r["text"]) for r in clean)
    assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in clean}
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    assert Counter((r["doc_id"], digest(r["text"])) for r in mixed) == Counter((r["doc_id"], r["decoded_sha256"]) for r in tokens)


def test_pipeline_on_awkward_rows(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())


@pytest.mark.parametrize("same", [True, False])
def test_repeats_of_one_id_leave_the_other_labels(spark, same):
    """An id with more rows than the sample must not push out the labels of a class."""
    hot = [(0, "junk " * (3 if same else k)) for k in range(1, 61)]
    docs = spark.createDataFrame(
        [*hot, *((k, f"{'A fine sentence.' if k % 2 else '|||| ####'} {k}") for k in range(1, 21))], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(21)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, sample=30).weights.any()
    assert abs(toxicity.train(docs, labels, sample=30).bias) < 1


def test_jaccard_with_empty_blocks(spark, monkeypatch):
    """Blocks by n-grams: with more blocks than texts some are empty, and links count once."""
    monkeypatch.setattr(jaccard, "PAIRS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 200)
    base = words(40, 200)
    given = [(k, " ".join([*base[: 8 * k], f"edit{k}", *base[8 * k + 1 :]])) for k in range(24)]
    rows = jaccard.jaccard_groups(spark.createDataFrame(given, "doc_id long, text string")).collect()
    sets = {i: grams(t) for i, t in given}
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets.values()) - 1 for i, a in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in rows} == want


@pytest.mark.parametrize("pairs", [jaccard.PAIRS, 1])
def test_jaccard_links_rows_without_id(spark, pairs, monkeypatch):
    """Two documents are joined through a text that only rows without id hold."""
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    base = words(60, 200)

    def edited(*places):
        return " ".join("changed" if k in places else w for k, w in enumerate(base))

    lone = words(61, 200)
    given = [
        (1, edited(20, 60, 100)), (2, edited(40, 80, 120)), *[(None, edited())] * 3,
        (None, " ".join(lone)), (None, " ".join(["changed", *lone[1:]])),
    ]
    rows = jaccard.jaccard_groups(spark.createDataFrame(given, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in rows)
    assert got == Counter({(1, 1, 1, 0, 3): 1, (2, 1, 2, 0, 3): 1, (None, 1, None, 2, 4): 3, (None, None, None, 0, 1): 2})


def test_mixing_deals_copies_among_equal_rows(spark):
    """Repeated rows that hold most of a source meet its target to a document, in the mix and the pipeline."""
    given = [(1, "a " * 10, "a")] * 999 + [(None, f"x{k} " * 10, "a") for k in range(501)] + [(2, "b " * 7, "b")] * 300
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    rows = mixing.mix(sized, weights=(15.0, 2.1), total=1.3).collect()
    assert sum(r["n"] for r in rows) == len(given)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["n"] * r["copies"] * r["size"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 10 for r in rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    target = {r["source"]: r["target"] for r in mixing.mix(sized).collect()}
    words_of = Counter()
    for r in mixed:
        words_of[r["source"]] += len(r["text"].split())
    assert all(abs(words_of[s] - target[s]) <= 10 for s in target)
    assert set(Counter(r["text"] for r in mixed if r["doc_id"] is None).values()) <= {1, 2}
