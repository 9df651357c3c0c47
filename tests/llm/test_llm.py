"""Numbered operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallymill.llm import bpe, mixing, nbsvm, onebit, queries, recompress, simhash, similar, template, urlfilter, vafile, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, ids string"


def words(t):
    return WORD.findall(t or "")


def documents(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    out = []
    for i in range(n):
        t = " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 30, 80, 200])))
        if i % 10 == 3:
            t = out[-1][1]
        if i % 10 == 4 and out[-1][1]:
            t = out[-1][1] + " x"
        if i % 9 == 5:
            t = f"{t}\t{passage}\n {i}"
        out.append((i if i % 13 else None, None if i % 17 == 0 else t, None, [None, "é", "a", "b", "z"][i % 5], None, "x", 1, None))
    out += [(507, "same row twice", None, "a", 3, None, None, None)] * 2 + [(500, "w " * 20_000, "en", "a", 1, "", 0, ""), (501, "", None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def as_sorted(rows):
    return sorted(map(tuple, rows), key=str)


# SimHash


def brute_fingerprint(t):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f if f < 2**63 else f - 2**64, least.get(find(i))) for i, (r, f) in enumerate(zip(rows, fps))]


def test_simhash_is_brute_force(docs, none):
    assert as_sorted(simhash.near_duplicates(docs).collect()) == as_sorted(brute_components(documents()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_tally_counts_positional_bytes():
    rnd = random.Random(6)
    fps = np.unique(np.array([rnd.getrandbits(64) & 0x0303030303030303 for _ in range(60)], np.uint64))
    shared = lambda a, b: sum(x == y for x, y in zip(int(a).to_bytes(8), int(b).to_bytes(8)))
    want = {(i, j) for j in range(len(fps)) for i in range(j) if shared(fps[i], fps[j]) >= 5}
    got = set(zip(*(x.tolist() for x in simhash.tallied(fps))))
    assert got == want and 0 < len(want) < len(fps) * (len(fps) - 1) / 4  # what is verified afterwards


def test_simhash_splits_hot_lists_exactly(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(6) << 40 | rnd.getrandbits(5) << 9 | 12345 for _ in range(400)}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for most in (2, 1024):
        got = {frozenset(map(tuple, g)) for g in [[(r.node, r.root) for r in simhash.components(simhash.links(nodes, most)).collect()]]}
        roots = {}
        for node, r in next(iter(got)):
            roots.setdefault(r, set()).add(node)
        left, groups = set(fps), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                x = todo.pop()
                seen.add(x)
                near = {y for y in left if (x ^ y).bit_count() <= 3}
                left -= near
                todo += near
            groups.append(seen)
        assert sorted(map(sorted, roots.values())) == sorted(sorted(g) for g in groups if len(g) > 1)


def test_every_three_positions_leave_a_block_untouched():
    from itertools import combinations

    assert all(any(not set(e) & set(b) for b in simhash.steiner()) for e in combinations(range(8), 3))


def test_keep_one_keeps_one_of_each_component(docs):
    rows = brute_components(documents())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 507").count() == 1
    assert {r.doc_id for r in kept.collect()} - {None} == {r[2] for r in rows} - {None}


# Near-copies by shingles


def brute_groups(texts, width=5):
    """Root of each text under links at a Jaccard index of 0.8 or more."""
    split = [words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in split]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def near_copies(seed=7):
    """documents() and chains of texts, each with some words of the one before changed: about 0.7 to 0.95 alike."""
    rnd, out = random.Random(seed), documents()
    for i in range(30):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([5, 6, 9, 10, 40, 100, 300]))]
        for j in range(5):
            out.append((1000 + 5 * i + j, " ".join(w).upper() if j == 2 else " ".join(w), None, "a", 1, None, None, None))
            for _ in range(max(1, len(w) // rnd.choice([30, 60, 100]))):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(10**6)}"
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_near_copies_are_those_of_all_pairs(spark, none, block):
    rows = near_copies()
    least = {}
    for g, r in zip(brute_groups([r[1] for r in rows]), rows):
        least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    got = similar.keep_one(spark.createDataFrame(rows, DOCS), block=block)
    assert got.columns == DOCS.replace(",", "").split()[::2]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(least.values())
    assert similar.keep_one(none, block=block).count() == 0


# Recompression


def brute_repeats(rows, window):
    seen = collections.Counter(tuple(words(r[1])[p : p + window]) for r in rows for p in range(len(words(r[1])) - window + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [5, 35])
def test_recompression_is_brute_force(docs, none, window):
    assert as_sorted(recompress.summaries(docs, window=window).collect()) == as_sorted(brute_repeats(documents(), window))
    assert recompress.summaries(none).count() == 0


def test_recompression_of_runs_and_few_words(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("ab"[: 1 + i % 2]) for _ in range(rnd.randrange(90)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_sorted(recompress.summaries(df, window=8).collect()) == as_sorted(brute_repeats(rows, 8))


def test_strip_repeats_keeps_rows_and_columns(docs):
    out = recompress.strip_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert out.where("doc_id = 500").first().text == ""


# BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.vocabulary_path()), special_tokens={})


def test_bpe_matches_the_library(encoding):
    rnd, codec = random.Random(1), bpe.codec(queries.vocabulary_path())
    alphabet = "ab'srevldtmDS  \t\n\r\x0b\x1c\x85\u2028\u3000é1²½٣!?-—漢字\U0001f600\u0301\0_'’"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["", " ", "a" * 3000, "'" * 300, "don't 's  'll\n 's ''s 're're", "<|endoftext|>"]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert codec.offsets(ids)[-1] == len(text.encode())


def test_bpe_digests_and_round_trip(docs, none, encoding):
    path = queries.vocabulary_path()
    want = []
    for r in documents():
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert as_sorted(bpe.digests(docs, path).collect()) == as_sorted(want)
    back = bpe.decode(bpe.encode(docs, path), path)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert bpe.digests(none, path).count() == 0 and bpe.encode(none, path).count() == 0


# Classifier


def test_classifier_learns_style(spark, none):
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("aeioustn") for _ in range(5)) + ("" if i % 4 else rnd.choice(["!!", "$$$"])) for _ in range(40)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "y"), (9999, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels)
    got = nbsvm.score(docs, model).select("doc_id", "score", nbsvm.held_out("doc_id").alias("h")).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.h]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.h for r in got if r.doc_id is not None)
    assert np.mean([(r.score >= nbsvm.THRESHOLD) == (r.doc_id % 4 > 0) for r in held]) > 0.95
    again = nbsvm.train(docs, labels)
    assert np.array_equal(model.weight, again.weight) and model.bias == again.bias
    assert nbsvm.score(none, model).count() == 0


def test_classifier_without_labels_or_with_one_class(spark, docs):
    labels = "doc_id long, quality int"
    assert nbsvm.train(docs, spark.createDataFrame([], labels)) is None
    assert {r.score for r in nbsvm.score(docs, None).collect()} == {0.5}
    one = nbsvm.train(docs, spark.createDataFrame([(i, 1) for i in range(1, 12)], labels))
    assert min(r.score for r in nbsvm.score(docs, one).collect()) > 0.9


def test_classifier_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_nb_svm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93


def test_classifier_is_fitted_in_a_task(spark, docs, monkeypatch):
    def in_driver(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(nbsvm, "fit", in_driver)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels)
    assert model.ratio.shape == model.weight.shape == (1 << nbsvm.BITS,)


def test_classifier_is_the_model_of_the_definition():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) for _ in range(60)]
    y = np.array([int((r < 15).sum() > (r >= 25).sum()) for r in rows])
    ratio = nbsvm.log_count_ratio(rows, y)
    count = {k: [1.0 + sum(f in r for r, q in zip(rows, y) if q == k) for f in range(40)] for k in (0, 1)}
    total = {k: sum(c) + len(ratio) - 40 for k, c in count.items()}
    assert np.allclose(ratio[:40], [np.log(count[1][f] / total[1]) - np.log(count[0][f] / total[0]) for f in range(40)])
    w, bias = nbsvm.fit_hinge(rows, y, ratio)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r], x[i, 40] = ratio[r] / np.linalg.norm(ratio[r]), 1
    sign = np.where(y == 1, 1, -1)
    cost = np.where(y == 1, 30 / (y == 1).sum(), 30 / (y == 0).sum())
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = v = np.zeros(41)
    for t in range(1, 20_000):  # subgradient steps on the same objective
        v = v - (v - x.T @ (cost * sign * (sign * (x @ v) < 1))) / t
        best = min(best, v, key=loss)
    assert loss(np.append(w[:40], bias)) <= loss(best) + 1e-3 * loss(best)


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "source", "_id", "_raw", "_key", "_ranges", "_tk", "_row_key", "_no", "_place", "n", "h", "y", "f"]
    rows = [(i, f"w{i % 5} " * 50, "s", *range(len(names) - 3)) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string' if c in ('text', 'source') else 'int'}" for c in names))
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(12)], "doc_id long, quality int, id int")
    outs = [nbsvm.score(docs, nbsvm.train(docs, labels)).drop("score"), simhash.keep_one(docs), similar.keep_one(docs), recompress.strip_repeats(docs), mixing.mixed(docs)]
    outs.append(bpe.encode(docs, queries.vocabulary_path()).drop("ids", "offsets"))
    for out in outs:
        got = out.collect()
        assert out.columns == names and got and all(tuple(r)[3:] == rows[0][3:] for r in got)


# WARC


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(5, "http://a/1", big, 0), (3, "http://a/2\r\nX: y", big, 0), (9, None, big, 0), (1, "u", small, 0), (2, "u", small, 0), (4, "v", None, 0), (6, "v", "", 0), (3, "w", big, 0), (None, "n", big, 0), (7, "long", "y" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    index = warc.write(pages, str(tmp_path / "bundles"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, index).collect()]
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        again = html == big and page != 3
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert as_sorted(got) == as_sorted(want)
    found = warc.lookup(index, spark.createDataFrame([(7,), (1,), (77,)], "page_id long")).collect()
    assert sorted(r.page_id for r in found) == [1, 7] and all(bytes(r.record).startswith(b"WARC/1.1\r\n") for r in found)
    assert warc.archive(pages.where("false")).count() == 0


def test_warc_keeps_any_identifier(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * 200, i) for i in ("b:1", "a <é>/%", "", None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, digest string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert got == {("", "response", None), ("b:1", "revisit", ""), ("a <é>/%", "revisit", ""), (None, "revisit", "")}


# URL filter


def test_url_filter_is_brute_force(spark):
    urls = ["https://Ex.example.org/es/1", "http://example.org/en/12?x=1", "http://x.org", "http://x.org/a", "http://x.com/fr/", "http://x.com/de/#a", "http://spam.com/a/", "http://www.spam.com/a?b", "HTTP://m.spam.com/b", "no scheme", None, "", "a://b://c/d", "http://notexample.org/es/", "http://ÀB.net/É", "http://x.net?y=/de/"]
    pages = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.com/a",), (None,), ("spam.com/a",)], "url_key string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in urlfilter.judge(pages, queries.RULES, listed).collect()}
    want = set()
    for i, u in enumerate(urls + urls[:3]):
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups() if u and "://" in u else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        key = re.sub(r"^(www|m)\.", "", host) + path.rstrip("/")
        best = max(fits) if fits else (0, None, "block" if key == "spam.com/a" else "allow")
        want.add((i, host, path, best[1], best[2], key == "spam.com/a"))
    assert got == want
    assert urlfilter.judge(pages, [], listed.where("false")).where("verdict = 'block'").count() == 0


def test_bloom_filter_has_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '/p') as url_key")
    pages = spark.range(6000).selectExpr("id as page_id", "concat('http://h', id, '/p') as url")
    got = urlfilter.judge(pages, [], listed)
    assert got.where("listed").count() == 3000 and got.where("possible and not listed").count() < 60


def test_url_is_blocked_for_itself(spark):
    listed = urlfilter.url_list(spark, queries.BLOCK_HOSTS, queries.BLOCK_SECTIONS, 20)
    assert listed.count() == listed.distinct().count() == 18 * 4 * 10
    urls = ["http://m.adult-x.example.net/en/4?a", "http://m.adult-x.example.net/en/5", "https://adult-x.example.net/en/6.html/", "http://adult-x.example.net/en/6"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, _judged int, block int")
    got = urlfilter.judge(pages, [], listed).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "allow", "block", "allow"] and all(r.possible for r in got if r.listed) and got[0]["_judged"] == 1


# Mixing


def brute_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    left, target, rest = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, {}, 1.5 * sum(sizes.values())
    while left:
        total = sum(left.values())
        full = [k for k in left if left[k] / total * rest > 2 * sizes[k]]
        if not full:
            return target | {k: w / total * rest for k, w in left.items()}
        for k in full:
            target[k] = 2.0 * sizes[k]
            rest -= target[k]
            del left[k]
    return target


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_meets_targets(docs, none, block):
    rows = mixing.mix(docs, block=block).collect()
    size = collections.Counter()
    for r in documents():
        size[r[3]] += len(words(r[1]))
    target, taken = brute_targets(size), collections.Counter()
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += (r["last"] - r["first"]) if r.lap is not None else 0
    assert all(abs(taken[k] - target[k]) < 1 for k in size)
    got = mixing.taken_words(docs, block=block).collect()
    assert as_sorted((r.doc_id, r["size"]) for r in got) == as_sorted((r[0], len(words(r[1]))) for r in documents())
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert as_sorted(got) == as_sorted(mixing.taken_words(docs, block=block).collect())
    out = mixing.mixed(docs, block=block)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.taken_words(none).count() == 0 and mixing.mixed(none).count() == 0


def test_schedule_is_even_everywhere(spark):
    sources = spark.createDataFrame([(0, 3000, 0, 3 * 2**29), (1, 1000, 3 * 2**29, 2**31)], "src int, need long, lo long, hi long")
    slots = sorted((r.slot, r.src, r.rank) for r in mixing.schedule(sources, 4000).collect())
    assert collections.Counter(s for _, s, _ in slots) == {0: 3000, 1: 1000}
    assert all(sorted(r for _, s, r in slots if s == k) == list(range(n)) for k, n in ((0, 3000), (1, 1000)))
    for at in range(0, 3900, 100):
        assert abs(sum(s for _, s, _ in slots[at : at + 100]) - 25) <= 2


# Templates


PAGE = '<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><main><article><header><h1>T&eacute;</h1></header><p>a <span>b</span>c<br>d&nbsp;&lt;x&gt;<script>var t="</p>";</script><div class="x ad-slot">AD</div><p>{}<p>Share this<ul><li>f<li>g</ul><form>zz</form><section id="comments"><p>hey</p></section></article></main><aside>s</aside><footer>f</footer>'


def whole_text(page):
    return template.main_text(page)


def test_main_text_of_a_page():
    assert whole_text(PAGE.format("e")) == "Té\na bc d <x>\ne\nShare this\nf\ng"
    assert whole_text("") == "" and whole_text("a < b") == "a < b"
    assert whole_text("<div class=nav>x</div><p>only body<p>" + "y" * 100_000) == "only body\n" + "y" * 100_000


def test_class_words_of_wrappers_do_not_drop_the_article():
    text = lambda page: whole_text(page)
    for name in ("layout has-sidebar", "content no-sidebar", "post share-enabled", "with-comments", "elementor-widget-text", "sidebar", "page-menu"):
        assert text(f'<body><div class="{name}"><article><h1>T</h1><p>the text</article></div><div class="menu">m</div>') == "T\nthe text", name
        assert text(f'<body><div class="{name}"><h1>T</h1><p>the text</div><div class="menu">m</div>') == "T\nthe text", name
    assert text('<p>a long text of the body</p><div class="related"><article>card</article><article>card</article></div>') == "a long text of the body"
    assert text('<article>a</article><div id="comments"><article class="comment">a longer comment</article></div><div class="widget widget_text">w</div>') == "a"
    assert text('<div id="comments"><article>a long comment</article></div><p>a') == "a"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>x</title><body><article><p>hello world", "hello world"),
        ("<article><p>one</p><svg/><p>two</p>", "one\ntwo"),
        ("<article><p>one</p><iframe src='a' /><p>two</p>", "one\ntwo"),
        ("<article><p>one<iframe src='a'><p>two</p>", "one\ntwo"),
        ("<main><p>long main text</p><article><p>teaser</p></article><p>more main</p></main>", "long main text\nteaser\nmore main"),
        ("a <math>x</math> b", "a x b"),
        ("<article>a <noscript>picture</noscript><object data=x>instead</object> b<svg><text>no</text></svg></article>", "a pictureinstead b"),
        ("<article><p>a<select><option>b</select><p>c<script>d", "a\nc"),
    ],
)
def test_end_tags_that_are_left_out(page, text):
    assert whole_text(page) == text


def host_pages():
    """Pages without any marks: a head and foot of constant texts, one of them twice, around texts of their own; odd and empty pages."""
    rnd = random.Random(9)
    word = lambda: f"w{''.join(rnd.choice('abcdefgh') for _ in range(6))}"
    out = []
    for i in range(9):
        own = "".join(f"<p>{word()} {word()}" for _ in range(rnd.randrange(1, 5))) + ("<p>All rights" if i == 4 else "")
        note = "<div class='k'>Seen in print</div>" if i % 3 else ""
        out.append(f"<html><head><title>t<body><div class='top'>Site name</div><div>Home</div>{note}<div class='t'><h1>{word()}</h1>{own}</div><div class='end'>All rights</div><div>Home</div>")
    return [*out, "", None, f"<p>another layout<p>{word()}", out[0].replace("Site", "Site")]


def brute_template(pages, share=0.5):
    """Texts of a host's pages, by occurrence vectors written out in full."""
    parsed = [template.parse(p or "") for p in pages]
    orders = [template.events(*x) for x in parsed]
    seen, real = set(), []
    for p, order in zip(pages, orders):
        if order and p not in seen:
            real.append(order)
        seen.add(p)
    vectors = {t: tuple(sum(x == t for x, _ in order) for order in real) for order in real for t, _ in order}
    least = max(2, -(-len(real) * share // 1))
    support = {t: sum(map(bool, v)) for t, v in vectors.items()}
    classes = {t: (v, support[t], sum(v) == support[t]) for t, v in vectors.items() if support[t] >= least}

    def stands(order):
        known = [(t, b) for t, b in order if t in classes]
        out = []
        for n, (t, b) in enumerate(known):
            _, pages_of, once = classes[t]
            above = lambda x: classes[x][2] and (classes[x][1] > pages_of or classes[x][1] == pages_of and not once)  # noqa: B023, E731
            left = next((x for x, _ in reversed(known[:n]) if above(x)), None)
            right = next((x for x, _ in known[n + 1 :] if above(x)), None)
            out.append(((classes[t][0], left, right), t, b))
        ranks, done = {}, []
        for slot, t, b in out:
            of = ranks.setdefault(slot, [])
            of += [t] * (t not in of)
            done.append(((t, *slot[1:], of.index(t)), b))
        return done

    count = collections.Counter(place for order in real for place in {x for x, _ in stands(order)})
    texts = []
    for (blocks, _), order in zip(parsed, orders):
        constant = {b for x, b in stands(order) if count[x] >= least}
        texts.append("\n".join(b[1] for i, b in enumerate(blocks) if i not in constant))
    return texts


def test_template_is_brute_force_and_decides(spark):
    html = host_pages()
    pages = spark.createDataFrame([(i, f"http://h.com/{i}", h, "k") for i, h in enumerate(html)], "page_id long, url string, html string, _judged string")
    got = {r.page_id: r.text for r in template.extract(pages).collect()}
    assert [got[i] for i in range(len(html))] == brute_template(html)
    assert all("Site name" not in got[i] and "Home" not in got[i] and "Seen" not in got[i] for i in range(9)) and got[4].endswith("\nAll rights") and got[0] == got[12]
    alone = {r.page_id: r.text for r in template.extract(pages, min_pages=99).collect()}
    assert sum(got[i] != alone[i] for i in range(9)) == 9


def test_repeated_articles_stay(spark):
    """Print views, a shared passage, and pages that are nothing but what others repeat."""
    story = "<h1>One story</h1><p>Its first part.<p>Its second part."
    rows = [
        (1, "http://a.com/1", f"<article>{story}</article><footer>f</footer>"), (2, "http://a.com/1p", f"<article>{story}</article><footer>another</footer>"), (3, "http://a.com/2", "<article><p>other words</article>"),
        (4, "http://b.com/1", "<article><p>A passage.</article>"), (5, "http://b.com/2", "<article><p>A passage.<p>And more.</article>"),
        *((10 + i, f"http://c.com/{i}", f"<article><p>The same.{'<p>own ' + 'xyzuvw'[i] if i else ''}</article>") for i in range(6)),
    ]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "One story\nIts first part.\nIts second part."
    assert got[1] == got[2] == whole and got[3] == "other words" and got[4] == "A passage." and got[5] == "A passage.\nAnd more."
    assert got[10] == "The same." and got[11] == "own y"


def test_template_takes_constant_texts(spark):
    word = lambda i, j: "".join("abcdefghij"[int(c)] for c in str(100 + i * 10 + j))
    rows = [(i, f"http://h.com/{i}", PAGE.format(f"text {word(i, 0)} " + "".join(f"<p>more {word(i, j)}" for j in range(1, 6))), "k") for i in range(6)] + [(None, None, None, "k"), (50, "http://one.com/", PAGE.format("z"), "k")] + [(60, "http://h.com/0", "", "k")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in template.extract(pages).collect()}
    assert template.extract(pages).count() == len(rows)
    assert got[None].text == "" and got[None].n_chars == 0 and got[60].text == ""
    assert "Share this" in got[50].text
    assert "Share this" not in got[2].text and f"text {word(2, 0)}" in got[2].text
    assert template.extract(pages.where("false")).count() == 0


# Vector search


def vectors(n=400, d=24):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, d)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(600, rows[0][1], 0), (601, rows[0][1], 0), (700, None, 0), (750, [1.0, None] * 12, 0), (800, [float("nan")] * d, 0), (850, [0.0] * d, 0), (900, [float("inf")] * d, 0), (None, rows[1][1], 0), (950, [1.0], 0), (5, rows[5][1], 0)]
    return rows


def brute_search(rows, every, k, change):
    ok = [(i, np.array(change(np.array(v, float)))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            near = sorted((-float(np.cumsum(q * v)[-1]), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return out


def test_va_file_is_exact(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, score int")
    got = vafile.top_k(df).collect()
    assert as_sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in got) == as_sorted(brute_search(vectors(), 50, 5, lambda v: np.floor(256 * v)))
    assert vafile.top_k(df.where("false")).count() == 0
    assert vafile.top_k(df.where("vec_id = 950")).count() == 0


def test_one_bit_codes_find_the_nearest(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, score int")
    got = onebit.nearest(df).collect()
    want = brute_search([r for r in vectors() if r[1] and any(r[1])], 20, 20, lambda v: v)
    found, true = {(r.query_id, r.vec_id): r.score for r in got}, {(q, v): s for q, _, v, s in want}
    assert len(found) == len(true) and len(found.keys() & true.keys()) >= 0.9 * len(true)
    assert all(found[k] == true[k] for k in found.keys() & true.keys())
    assert onebit.nearest(df.where("false")).count() == 0


def test_few_vectors_are_read_exactly(spark):
    from tallymill.llm import blocks

    x = np.random.default_rng(8).standard_normal((20_000, 32))
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "row long, vec_id long, vec array<double>").cache()
    queries = df.where("vec_id % 1000 = 0")
    for method, k, most in ((vafile, 5, 40), (onebit, 20, 2000)):
        codes = blocks.coded(df, method.encode)
        assert codes.selectExpr("max(length(code))").first()[0] == 32
        found = blocks.scan(queries, codes, 20, 20_000, method.bounds, k).groupBy("query").count().collect()
        assert len(found) == 20 and all(k <= r["count"] <= most for r in found)


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns and docs.count() > 0, name
    assert corpus_pipeline.run(spark, sf).columns[0] == "doc_id"
