"""Every stage of the pipeline against brute force on its own input, and run() against the chain: nulls, empty and long texts, repeats, near copies, shared passages, clashing and odd column names."""

import collections
import hashlib
import random

import numpy as np
import pytest
from test_llm import brute_groups, brute_targets, words

import corpus_pipeline
from tallymill.llm import bpe, nbsvm, queries, recompress, similar, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, `meta.x` int, _score double, `a``b c` int"


def corpus():
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("aeioustn") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(50))
    out, labels = [], []
    for i in range(260):
        bad = i % 4 == 0
        w = [rnd.choice(vocab) + (rnd.choice(["!!!", "$$$"]) if bad and rnd.random() < 0.5 else "") for _ in range(rnd.choice([30, 60, 150]))]
        t = " ".join(w)
        if i % 10 == 3:
            t = out[-1][1]
        if i % 10 == 7:
            t = out[-1][1] + " end"
        if i % 9 == 5:
            t = f"{t}\n{passage}\t{rnd.choice(vocab)}"
        out.append((i if i % 31 else None, t, "en", ["a", "b", "c", None][i % 4 if i % 3 else 0], len(t), "x", 1, 0.5, i))
        labels.append((i, int(not bad), 0))
    out += [(900, None, None, "a", None, None, None, None, None), (901, "", "en", "b", 0, None, None, None, None), (902, " \n ", "en", None, 3, None, None, None, None), (903, "Ünï " * 6000, "en", "a", 24000, None, None, None, None)]
    out += [(905, "the same row twice over and over", "en", "a", 32, None, None, None, None)] * 2
    return out, labels + [(None, 1, 0), (905, None, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and behind each."""
    sf = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(f"{sf}/out/{n}")
        frames.append(spark.read.parquet(f"{sf}/out/{n}"))
    return sf, frames, [f.collect() for f in frames]


def counted(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_stages_keep_the_columns(stages):
    _, frames, rows = stages
    assert all(f.columns == frames[0].columns for f in frames[:5]) and all(rows)
    assert [dict(f.dtypes) for f in frames[:5]] == [dict(frames[0].dtypes)] * 5


def test_quality_rejects_what_it_scores_low(spark, stages):
    sf, frames, rows = stages
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    model = nbsvm.train(frames[0], labels)
    want = [r for r in nbsvm.score(frames[0], model, out="own_score").collect() if r.own_score >= nbsvm.THRESHOLD]
    names = frames[0].columns
    assert counted(rows[1], *names) == counted(want, *names)
    truth = {i: q for i, q, _ in corpus()[1]}
    kept = {r.doc_id for r in rows[1]}
    judged = [(i, q) for i, q in truth.items() if i is not None and q is not None and i < 260 and i % 31 and i % 10 not in (3, 7)]
    assert sum((i in kept) == bool(q) for i, q in judged) > 0.9 * len(judged)


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = stages[2]
    least, size = {}, collections.Counter()
    for g, r in zip(brute_groups([r.text for r in rows[1]]), rows[1]):
        size[g] += 1
        least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert max(size.values()) > 1
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows[2]) == sorted(least.values())
    assert not counted(rows[2], *rows[2][0].asDict()) - counted(rows[1], *rows[1][0].asDict())


def test_repeated_passages_go(stages):
    rows = stages[2]
    seen = collections.Counter(tuple(words(r.text)[p : p + 35]) for r in rows[2] for p in range(len(words(r.text)) - 34))
    want = []
    for r in rows[2]:
        w, gone = words(r.text), set()
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                gone |= set(range(p, p + 35))
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text
        want.append((r.doc_id, text, None if text is None else len(text)))
    assert collections.Counter(want) == counted(rows[3], "doc_id", "text", "n_chars")
    assert sum(t != r.text for (_, t, _), r in zip(want, rows[2])) > 5


def test_the_mix_meets_its_targets(stages):
    rows = stages[2]
    sizes = collections.Counter()
    for r in rows[3]:
        sizes[r.source] += len(words(r.text))
    taken = collections.Counter()
    for r in rows[4]:
        taken[r.source] += len(words(r.text))
    targets = brute_targets(sizes)
    assert len(targets) == 4 and all(abs(taken[s] - targets[s]) < 1 for s in sizes)
    texts = collections.defaultdict(list)
    for r in rows[3]:
        texts[r.doc_id, r.source].append((r.text, " " + " ".join(words(r.text)) + " "))
    for r in rows[4]:
        assert any(r.text == whole or f" {r.text} " in line for whole, line in texts[r.doc_id, r.source])
        assert r.n_chars == len(r.text)
    words_of = collections.Counter()
    for r in rows[4]:
        words_of[r.doc_id, r.source] += len(words(r.text))
    assert all(n <= 2 * sum(len(words(t)) for t, _ in texts[k]) for k, n in words_of.items())


def test_tokens_are_those_of_the_library_and_run_is_the_chain(spark, stages):
    import public_tokenizers
    import tiktoken

    sf, _, rows = stages
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.vocabulary_path()), special_tokens={})
    want = collections.Counter()
    for r in rows[4]:
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert counted(rows[5], *names) == want
    assert counted(corpus_pipeline.run(spark, sf).collect(), *names) == want


def test_odd_names_pass_through(spark):
    names = ["doc_id", "text", "meta.x", "a`b c", "_column_2", "x-y"]
    docs = spark.createDataFrame([(i, f"word{i % 3} " * 40, 1, 2, 3, 4) for i in range(9)], ", ".join(f"`{n.replace('`', '``')}` {'string' if n == 'text' else 'long'}" for n in names))
    path = queries.vocabulary_path()
    outs = [recompress.strip_repeats(docs), nbsvm.score(docs, None).drop("score"), bpe.encode(docs, path).drop("ids", "offsets"), bpe.decode(bpe.encode(docs, path), path).drop("ids", "offsets", "decoded")]
    for out in outs:
        assert out.columns == names and all(tuple(r)[2:] == (1, 2, 3, 4) for r in out.collect()) and out.count() == 9


def test_empty_tables_go_through(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_come_through_the_fingerprint_index(spark, monkeypatch):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(400)) for _ in range(4)]
    texts = base + [t + f" end{i}" for i, t in enumerate(base)] + ["x y", " \n", ""]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, raw binary")
    asked, own = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *a: (asked.append(nodes.count()), own(nodes, *a))[1])
    found = {tuple(sorted(r)) for r in similar.indexed(rows).collect()}
    sets = [set(similar.shingles(t.encode()).tolist()) for t in texts]
    assert found and found >= {(9, 10)} and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in found)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 3, 8, 9]
    assert len(asked) == 2


@pytest.mark.parametrize("block", [2, similar.BLOCK])
def test_every_pair_that_the_index_can_see_is_checked(spark, block):
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(3000))
    texts = []
    for _ in range(3):  # a long refrain decides the fingerprint, the verses decide the sets: copies of a verse are like each other alone
        refrain = " ".join([" ".join(word() for _ in range(61))] * 100)
        verses = [" ".join(word() for _ in range(100)) for _ in range(4)]
        texts += [f"{refrain} {v}{end}" for end in ("", " end", " other end") for v in verses]
    texts += [" ".join(word() for _ in range(50)) for _ in range(5)]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    sets = [set(similar.shingles(t.encode()).tolist()) for t in texts]
    like = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = [(a, b) for b in range(len(texts)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 3 and like(a, b)]
    assert len(want) >= 24 and not any(like(a, b) for a in range(4) for b in range(a))
    found = [tuple(r) for r in similar.indexed(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, raw binary"), block).collect()]
    root = list(range(len(texts)))
    for a, b in found:
        assert like(a, b)
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    assert all(root[a] == root[b] for a, b in want)
