"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import chroma, crf, jaccard, language, lines, mixing, packing, pieces, quality, secrets, style, urls, words
from sieveline.llm.queries import QUERIES, piece_model, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# Words and shingles


def test_word_hashes_are_those_of_the_words(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\t\n\x0b日 ") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["x" * 5000, None, ""]
    for chunk in (7, 64, 1 << 19):
        monkeypatch.setattr(words, "CHUNK", chunk)
        hashes, at = words.word_hashes(pa.array(texts, pa.string()))
        seen = {}
        for i, t in enumerate(texts):
            own = WORD.findall((t or "").translate(FOLD))
            assert at[i + 1] - at[i] == len(own)
            for w, h in zip(own, hashes[at[i] : at[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# 3: Jaccard join


def components_of(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    """Groups of chained near copies, shared passages, short texts and equal ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = rng.choices(vocabulary, k=60)
    docs = []
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.choice([6, 12, 40, 150]))
        if group % 4 == 0:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 8, 20])):
            docs.append(" ".join(base))
            if rng.random() < 0.8:
                for _ in range(rng.choice([1, 1, 2, 4])):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                base.append(rng.choice(vocabulary))
    docs += ["a b", "A b", "b a", "same", "same", "", None]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_exact(spark, make_docs, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "TOGETHER", 4000)  # many batches
    monkeypatch.setattr(jaccard, "PART_BYTES", 8000)
    docs = near_copies(seed)
    df = make_docs([(i, t, "en", "s") for i, t in docs]).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark, df).collect()}
    assert got == components_of(docs)


def test_pairs_of_the_last_step_are_whole(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_ROUNDS", 1)  # what one round leaves must be found by the last step
    docs = near_copies(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark, make_docs([(i, t, "en", "s") for i, t in docs])).collect()}
    assert got == components_of(docs)


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_routers_change_no_component(spark, make_docs, monkeypatch, fan):
    monkeypatch.setattr(jaccard, "TOGETHER", 4000)
    monkeypatch.setattr(jaccard, "PART_BYTES", 1000)  # more parts than a batch addresses; with 2, more than two levels have
    monkeypatch.setattr(jaccard, "FAN", fan)
    docs = near_copies(4)
    df = make_docs([(i, t, "en", "s") for i, t in docs]).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark, df).collect()}
    assert got == components_of(docs)


def test_lists_of_one_component_are_not_shuffled_again(spark, make_docs, monkeypatch):
    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    lists, kept = {}, jaccard.Workspace.keep

    def keep(work, df, name):
        out = kept(work, df, name)
        if name.startswith("open-"):
            lists[name] = out.groupBy("token").agg(F.countDistinct("root").alias("roots")).where("roots < 2").count()
        return out

    rng, texts = random.Random(1), []
    for _ in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(60):
            copy = list(base)
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    df = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as in large tables
    try:
        start = shuffled()
        got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark, df).collect()}
        moved = shuffled() - start
        monkeypatch.setattr(jaccard.Workspace, "keep", keep)
        jaccard.link(spark, df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i - i % 60 for i in range(600)}
    assert moved < 9 * sum(map(len, texts)), moved  # 11.7 times with rounds that read every list
    assert lists and not any(lists.values())


def test_a_shingle_of_every_batch_is_asked_once_a_router(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TOGETHER", 400)
    monkeypatch.setattr(jaccard, "FAN", 3)
    rng = random.Random(6)
    docs = make_docs([(i, "one two three four five " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "en", "s") for i in range(200)]).repartition(4)
    routed = jaccard.gather(jaccard.ask(docs, 3, ["doc_id"], "text"), 6).collect()
    asked = [r for r in routed if r["kind"] == jaccard.ASK]
    counts = [dict(zip(jaccard._of_gaps(r["a"]).tolist(), jaccard._of_planes(r["b"], "u4").tolist())) for r in asked]
    total = {}
    for c in counts:
        for t, n in c.items():
            total[t] = total.get(t, 0) + n
    often = max(total, key=total.get)
    batches = len({r["batch"] for r in routed if r["kind"] == jaccard.SETS})
    assert total[often] == 200 and batches > 100 and sum(often in c for c in counts) <= 8
    assert len({(r["part"], r["batch"]) for r in asked}) == len(asked) and max(sum(r["batch"] == x for r in asked) for x in {r["batch"] for r in asked}) <= 8
    assert all(np.all(jaccard._of_gaps(r["a"]) >> np.uint64(58) == r["part"]) for r in asked)


# 4: secret scans


def spans_of(text):
    out = []
    for rank, (kind, rx, group, least) in enumerate(
        [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    ):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, text) if len(m[group]) >= least]
    return ",".join(x for *_, x in sorted(out))


def secret_texts():
    rng = random.Random(5)
    bits = ["token", "Secret", "API_KEY", "apikey", "passwd", ":", "=", " ", '"', "'", "abc", "123456", "deadbeefdeadbeef", "AKIA", "ABCD1234EFGH5678", "é", "🎉", "\n", "x=y", "password"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)]


def test_secrets_are_those_of_the_patterns(spark, make_docs):
    texts = secret_texts()
    found, _ = secrets.scan_all(spark, make_docs([(i, t, "en", "s") for i, t in enumerate(texts)]))
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(found).collect()}
    assert got == {i: spans_of(t) for i, t in enumerate(texts)} and any(got.values())


def test_ledger_grows_by_what_is_new(spark, make_docs):
    texts = secret_texts()
    first, second = make_docs([(i, t, "en", "s") for i, t in enumerate(texts[:200])]), make_docs([(i, t, "en", "s") for i, t in enumerate(texts[100:])])
    _, ledger = secrets.scan_all(spark, first)
    again = secrets.scan_increment(first, ledger)
    assert again.count() == 0
    new = secrets.scan_increment(second, ledger)
    assert {r["blob"] for r in new.select("blob").distinct().collect()} == {r["blob"] for r in second.select(secrets.address(F.col("text")).alias("blob")).distinct().subtract(ledger.select("blob").distinct()).collect()}
    changed = (*secrets.BASE_RULES[:2], secrets.Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}", version=2))
    due = secrets.scan_increment(first, ledger, changed)
    assert {(r["kind"], r["version"]) for r in due.select("kind", "version").distinct().collect()} == {("hex", 2)}
    found, whole = secrets.scan_all(spark, second, ledger)
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(found).collect()}
    assert got == {i: spans_of(t) for i, t in enumerate(texts[100:])}


# 1 and 5: random fields


def brute(scores, transition, start):
    """Marginals and the best labels by all sequences."""
    n, k = scores.shape
    total, marginal, best = 0.0, np.zeros((n, k)), (-math.inf, None)
    for ys in itertools.product(range(k), repeat=n):
        s = start[ys[0]] + sum(scores[i, y] for i, y in enumerate(ys)) + sum(transition[a, b] for a, b in zip(ys, ys[1:]))
        total += math.exp(s)
        for i, y in enumerate(ys):
            marginal[i, y] += math.exp(s)
        best = max(best, (s, ys), key=lambda x: x[0])
    return marginal / total, best[1], math.log(total)


def test_random_fields_against_all_sequences():
    rng = np.random.default_rng(2)
    lengths = np.array([4, 0, 1, 5, 3, 5])
    scores, transition, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    layout = crf.Layout(lengths)
    marginal, pairs, starts, logz = crf.forward_backward(layout, scores, transition, start, count=True)
    best = crf.viterbi(layout, scores, transition, start)
    at, whole = 0, 0.0
    for n in lengths:
        if n:
            m, b, z = brute(scores[at : at + n], transition, start)
            assert np.allclose(marginal[at : at + n], m) and tuple(best[at : at + n]) == b
            whole += z
        at += n
    assert math.isclose(logz, whole) and math.isclose(pairs.sum(), np.maximum(lengths - 1, 0).sum()) and math.isclose(starts.sum(), (lengths > 0).sum())


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got) and len(got) > 150
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)


def test_languages_of_switched_text():
    rng = random.Random(1)
    sounds = {"aa": ["ka", "ro", "mi"], "bb": ["the", "sh", "ing"]}
    text = lambda lang, n: " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(n))
    model = language.train([text(lang, 50) for _ in range(40) for lang in sounds], [lang for _ in range(40) for lang in sounds])
    raw, at = words.text_buffer(pa.array([text("aa", 10) + " " + text("bb", 20)]))
    w = language.letter_runs(raw, at)
    marginal, *_ = crf.forward_backward(crf.Layout(np.diff(w.texts)), model.scores(w), model.transition, model.start)
    assert (marginal.argmax(axis=1) == [0] * 10 + [1] * 20).mean() > 0.95
    assert model.transition[0, 0] > model.transition[0, 1]


def test_line_counts_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rng = random.Random(4)
    docs |= {10_000 + k: "".join(rng.choice(["a b c", "\n", " ", "x", "#", "é|", "\n\n", "a b c a b c", "\r"]) for _ in range(rng.randint(0, 30))) for k in range(200)}
    keys = list(docs)
    got = lines.judge(lines.train(np.zeros((0, lines.FEATURES)), np.zeros(0, dtype=int)), pa.array([docs[k] for k in keys]))
    for i, k in enumerate(keys):
        t = docs[k]
        w = WORD.findall(t)
        three = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j + d for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert bool(got["base_failed"][i]) == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_verdicts_follow_the_content(spark):
    rng = random.Random(3)
    plain = "\n".join(" ".join("".join(rng.choices(["ta", "ri", "mo", "en"], k=4)) for _ in range(12)) + "." for _ in range(8))
    menu = "\n".join(" | ".join(f"Menu{i}{j}" for j in range(12)) for i in range(8))
    model = lines.learn(table(spark, "/root/testdata/sf0.01", "documents"))
    got = lines.judge(model, pa.array([plain, menu, plain + "\n" + "All rights reserved.", plain[:60] + "\n" + menu]))
    assert got["kept"].tolist() == [True, False, True, False]


def test_transitions_of_long_texts_are_those_of_neighbours(make_docs):
    rng = random.Random(5)
    plain = lambda: " ".join("".join(rng.choices(["ta", "ri", "mo", "en"], k=4)) for _ in range(12)) + "."
    menu = lambda: " | ".join(f"Menu{rng.randint(0, 10**6)}" for _ in range(12))
    # at an even stride of two, the thinned lines were all of one kind
    turns = [(i, "\n".join(menu() if j % 2 else plain() for j in range(2 * lines.TRAIN_LINES - 1)), "en", "a") for i in range(20)]
    model = lines.learn(make_docs(turns))
    assert model.transition[lines.CONTENT, lines.BOILERPLATE] > model.transition[lines.CONTENT, lines.CONTENT]
    assert model.transition[lines.BOILERPLATE, lines.CONTENT] > model.transition[lines.BOILERPLATE, lines.BOILERPLATE]
    # only what begins a text counts as a start
    headed = [(i, "\n".join([menu()] + [plain() for _ in range(150)]), "en", "a") for i in range(20)]
    model = lines.learn(make_docs(headed))
    assert model.start[lines.BOILERPLATE] > model.start[lines.CONTENT]


# 2: quality


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_of_held_out_documents(spark, sf):
    labels = table(spark, f"/root/testdata/{sf}", "labels")
    got = QUERIES["op2_quality_classifier"](spark, f"/root/testdata/{sf}").join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, (3000, quality.FEATURES)), rng.normal(-2, 1, (1500, quality.FEATURES))
    unl = np.concatenate([rng.normal(2, 1, (3500, quality.FEATURES)), neg])
    model = quality.train(pos, rng.permutation(unl))
    assert abs(model.prior - 0.7) < 0.06
    assert (model.score(neg) < 0.3).mean() > 0.97 and (model.score(pos) >= 0.3).mean() > 0.97


def test_prior_is_about_the_share_among_labelled_rows(spark):
    from sieveline.llm.queries import quality_model

    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    share = labels.where("quality = 1").count() / labels.count()
    assert abs(quality_model(spark, sf, table(spark, sf, "documents")).prior - share) < 0.03


def test_risk_and_what_is_followed():
    rng = np.random.default_rng(4)
    loss = lambda z: sum(math.log(1 + math.exp(-x)) for x in z) / len(z)
    turned = 0
    for k in range(40):
        gp, gu, prior = rng.normal(2, 1, 7), rng.normal(rng.uniform(-4, 2), 1, 9), rng.uniform(0.2, 0.9)
        whole = lambda p, u: prior * loss(p) + (loss(-u) - prior * loss(-p))
        bracket = lambda p, u: loss(-u) - prior * loss(-p)
        assert np.allclose(quality.risk(gp, gu, prior), (prior * loss(gp), bracket(gp, gu)))
        follow, sign = (whole, 1) if bracket(gp, gu) >= 0 else (bracket, -1)
        turned += sign < 0
        dp, du = quality.descent(gp, gu, prior)
        for d, at in ((dp, 0), (du, 1)):
            for i in range(len(d)):
                step = [np.zeros(7), np.zeros(9)]
                step[at][i] = 1e-5
                numeric = (follow(gp + step[0], gu + step[1]) - follow(gp - step[0], gu - step[1])) / 2e-5
                assert abs(sign * numeric - d[i]) < 1e-7
    assert 0 < turned < 40


def plain_features(t):
    w = WORD.findall(t)
    n = max(1, len(w))
    of = lambda text, chars: sum(c in chars for c in text)
    upper, lower, lead = (sum(f(c) for c in t) for f in (lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z", lambda c: ord(c) > 127))
    letters, chars = max(1, upper + lower + lead), max(1, len(t))
    classes = "#*$%&<>", "|", "!", ".,;:?"
    digits, white = of(t, "0123456789"), of(t, " \t\x0b\x0c\r\n")
    other = sum(ord(c) < 128 for c in t) - upper - lower - digits - white - sum(of(t, c) for c in classes)
    three = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j + d for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for d in range(3)}
    lines_of, seen, again, echoes, parts = t.split("\n"), set(), 0, 0, collections.Counter()
    for line in lines_of:
        own = WORD.findall(line)
        echo = sum(a == b for a, b in zip(own, own[1:]))
        again += bool(own) and line in seen
        seen.add(line)
        echoes += echo
        m = max(1, len(own))
        capital, small = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
        for k, holds in enumerate((of(line, classes[0]) / m > 0.5, of(line, "|") / m > 0.3, of(line, "!") / m > 0.5, capital > 4 * small, 2 * echo > len(own))):
            parts[k] += len(own) * holds
    return [
        math.log1p(len(w)), (len(t) - white) / n, upper / letters, lead / letters, *[of(t, c) / n for c in classes], other / chars, digits / chars, math.log1p(len(lines_of)), len(w) / len(lines_of),
        len(set(w)) / n, len(cover) / n, echoes / n, again / len(lines_of), *[parts[k] / n for k in range(5)], min(len(w), 50) / 50,
    ]


def test_quality_counts_against_brute_force():
    rng = random.Random(14)
    texts = ["".join(rng.choice(["a b c", "\n", " ", "x y", "#", "é|", "\n\n", "AB CD!", "a a a", "\r", "12", "日本", "%(", "menu | home", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = quality.features(pa.array([*texts, None, ""]))
    assert got.shape == (402, quality.FEATURES)
    for t, x in zip([*texts, "", ""], got):
        assert np.allclose(x, plain_features(t)), t


# 6: packing


def naive_fit(lengths, capacity):
    rows = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rows if capacity - sum(r) >= n]
        if fits:
            max(fits, key=sum).append(n)
        else:
            rows.append([n])
    return sorted(sorted(r) for r in rows)


def test_best_fit_is_that_of_a_plain_search():
    rng = random.Random(6)
    for capacity in (1, 7, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(300))
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(capacity - sum(r) for r in naive_fit(lengths, capacity))


def test_packing_loses_nothing(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, SF, "documents")
    packed = packing.pack(docs, path, 50256, 256)
    encoder = packing.rank_encoder(path)
    want = {r["doc_id"]: [*encoder(r["text"]), 50256] for r in docs.collect()}
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), dtype="<u2").tolist() for r in packing.unpack(packed).collect()}
    assert got == want
    rows = packed.collect()
    assert sum(r["cu_seqlens"][-1] for r in rows) >= 0.97 * 256 * len(rows)
    for r in rows:
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        position = packing.positions(r["cu_seqlens"], 256)
        assert all(position[a] == 0 for a in r["position_resets"])


# 7: urls


def test_url_scores_against_plain_counts(spark):
    pages = table(spark, SF, "pages").select("page_id", "url")
    ruled = urls.with_rules(pages)
    examples = [(r["url"], int(r["said"] == "block")) for r in ruled.where("said is not null").collect()]
    counts = [collections.Counter(), collections.Counter()]
    contexts = [collections.Counter(), collections.Counter()]

    def grams(url):
        raw = [0] * urls.ORDER + [b + 1 for b in url.encode()] + [urls.SYMBOLS]
        for i in range(urls.ORDER, len(raw)):
            yield [(tuple(raw[i - k : i]), raw[i]) for k in range(urls.ORDER + 1)]

    for url, said in examples:
        for each in grams(url):
            counts[said].update(each)
            contexts[said].update((c, "*") for c, _ in each)

    def score(url):
        total, n = 0.0, 0
        for each in grams(url):
            n += 1
            for said, sign in ((0, 1), (1, -1)):
                p = 1 / urls.SYMBOLS
                for c, x in each:
                    p = (counts[said][c, x] + urls.WEIGHT * p) / (contexts[said][c, "*"] + urls.WEIGHT)
                total += sign * math.log(p)
        return total / n

    got = urls.judge(pages).collect()
    url_of = {r["page_id"]: r["url"] for r in pages.collect()}
    worst = [abs(r["lm_score"] - score(url_of[r["page_id"]])) for r in got]
    assert max(worst) < 1e-9
    for r in got:
        host = re.sub(r"^.*?://", "", url_of[r["page_id"]], count=1)
        host = re.split(r"[/?#]", host)[0].translate(FOLD)
        assert r["host"] == host


def test_url_scores_are_exact_with_more_grams_than_any_fixed_table(spark):
    rng = random.Random(7)
    hosts = ["a.org/", "b.example.org/es/", "c.com/fr/", "d.com/de/", "e.net/", "f.net/"]
    pages = [(i, "http://" + hosts[i % 6] + "".join(rng.choices("0123456789abcdef", k=40))) for i in range(6000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string").repartition(5)
    said = {r["page_id"]: r["said"] for r in urls.with_rules(df).collect()}
    counts = {"allow": collections.Counter(), "block": collections.Counter()}

    def places(url):
        raw = "\0" * urls.ORDER + url + "\1"
        return [[raw[i - k : i + 1] for k in range(urls.ORDER + 1)] for i in range(urls.ORDER, len(raw))]

    for i, url in pages:
        if said[i]:
            for each in places(url):
                counts[said[i]].update(each)
                counts[said[i]].update((g[:-1],) for g in each)
    assert sum(len(g) == urls.ORDER + 1 for g in counts["allow"] if isinstance(g, str)) > 60_000

    def p(n, each):
        out = 1 / urls.SYMBOLS
        for g in each:
            out = (n[g] + urls.WEIGHT * out) / (n[(g[:-1],)] + urls.WEIGHT)
        return out

    got = {r["page_id"]: r["lm_score"] for r in urls.judge(df).collect()}
    assert len(got) == len(pages)
    for i, url in pages[::20]:
        each = places(url)
        assert abs(got[i] - sum(math.log(p(counts["allow"], e) / p(counts["block"], e)) for e in each) / len(each)) < 1e-9


def test_url_rules_by_length(spark):
    rows = [(1, "http://a.example.org/en/1"), (2, "http://example.org/en/2"), (3, "http://xexample.org/es/"), (4, "http://de.com/de/"), (5, "http://com/fr/x"), (6, "http://org"), (7, "http://a.net/")]
    got = {r["page_id"]: (r["rule"], r["said"]) for r in urls.with_rules(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("org/", "allow"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, None), 7: (None, None)}


# 8: recordings


def test_shifted_and_noisy_recordings_are_found(spark):
    rng = np.random.default_rng(8)
    tune = lambda n: np.concatenate([chroma.tones(512)[k] for k in rng.integers(0, 49, n)])
    originals = [tune(70) for _ in range(30)]
    rows, truth = [], set()
    for i, w in enumerate(originals):
        rows.append((100 * i, w))
        cut = w[2048 + 256 * (i % 5) :]
        rows.append((100 * i + 1, cut + rng.normal(0, 0.02, len(cut))))
        truth.add((100 * i, 100 * i + 1, 8 + i % 5))
    rows += [(100 * i + 2, w) for i, w in enumerate(originals[:5])] + [(100 * i + 3, tune(70)) for i in range(30)]
    data = [(k, bytearray((w * 20000).astype("<i2").tobytes())) for k, w in rows]
    df = spark.createDataFrame(data, "vec_id bigint, audio binary")
    got = chroma.search(spark, df, "vec_id", "audio", F.col("vec_id") % 100 == 0).collect()
    members = {r["vec_id"]: r["class_id"] for r in got if r["kind"] == "member"}
    assert all(members[100 * i + 2] == 100 * i for i in range(5))
    matches = {(r["vec_id"], r["class_id"]): (r["shift"], r["wrong_bits"], r["bits"]) for r in got if r["kind"] == "match"}
    prints = {r["vec_id"]: np.frombuffer(bytes(r["codes"]), dtype="<u4") for r in chroma.fingerprint(df, "vec_id", "audio").collect()}
    brute_force = set()
    classes = sorted(set(members.values()))
    for q in {members[k] for k in members if k % 100 == 0}:
        for c in classes:
            x, y = prints[q], prints[c]
            for offset in range(-len(y) + 1, len(x)):
                wrong, bits = chroma.bit_errors(x, y, offset)
                if bits >= 32 * min(chroma.LEAST_OVERLAP, len(x), len(y)) and wrong <= chroma.MOST_ERRORS * bits:
                    brute_force.add((q, c))
    assert set(matches) <= brute_force and len(set(matches)) >= 0.9 * len(brute_force)
    assert sum(matches.get((q, c), (None,))[0] == s for q, c, s in truth) >= 27


# 9: mixing


def mixed_docs(make_docs):
    rng = random.Random(9)
    sizes = {"big": 3000, "mid": 400, "small": 60, "tiny": 8}
    return make_docs([(i, "w " * rng.randint(1, 30), "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))])


def test_weights_meet_the_targets(spark, make_docs):
    docs = mixed_docs(make_docs)
    draws, weights = mixing.mix(spark, docs, 1.0, entropy_share=0.8)
    w = {r["source"]: r for r in weights.collect()}
    assert math.isclose(sum(r["weight"] for r in w.values()), 1)
    entropy = -sum(r["weight"] * math.log(r["weight"]) for r in w.values())
    assert abs(entropy - 0.8 * math.log(4)) < 1e-4
    a = w["big"]["exponent"]
    z = sum(r["share"] ** a for r in w.values())
    assert all(math.isclose(r["weight"], r["share"] ** a / z) for r in w.values())
    _, capped = mixing.mix(spark, docs, 1.0, entropy_share=0.8, most_repeats=2.0)
    repeats = [r["quota"] / r["tokens"] for r in capped.collect()]
    assert max(repeats) <= 2.0 and max(repeats) > 1.98
    rows = draws.collect()
    by_source = collections.Counter()
    for r in rows:
        by_source[r["source"]] += r["tokens"]
    for s, r in w.items():
        assert r["quota"] - 30 <= by_source[s] <= r["quota"]
    # every pass but the last has every document once, and blocks have every source at its weight
    full = collections.Counter((r["source"], r["pass"]) for r in rows)
    sizes = {r["source"]: r["rows"] for r in w.values()}
    assert all(n == sizes[s] for (s, p), n in full.items() if (p + 1) * w[s]["tokens"] <= w[s]["quota"])
    assert len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    per_block = collections.Counter()
    for r in rows:
        per_block[r["block"], r["source"]] += r["tokens"]
    assert all(abs(per_block[b, "big"] - w["big"]["quota"] / mixing.BLOCKS) <= 60 for b in range(mixing.BLOCKS))


def test_tokens_before_a_draw_do_not_depend_on_buckets(spark, make_docs, monkeypatch):
    docs = mixed_docs(make_docs)
    a = {tuple(r) for r in mixing.mix(spark, docs, 1.0, 0.8)[0].collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert {tuple(r) for r in mixing.mix(spark, docs.repartition(5), 1.0, 0.8)[0].collect()} == a


def test_a_draw_is_made_if_it_still_fits(spark, make_docs):
    rng = random.Random(9)
    sizes = {f"long{k}": [40] * 10 + [20_000] for k in range(6)} | {f"odd{k}": [int(1.5 ** rng.randint(0, 18)) for _ in range(60)] + [0] * 5 for k in range(6)}
    sizes |= {None: [5, 7000, 300, 20, 1]}
    rows = [(s, n) for s, each in sizes.items() for n in each]
    docs = make_docs([(i, "w " * n, "en", s) for i, (s, n) in enumerate(rows)])
    draws, weights = mixing.mix(spark, docs, 0.7, entropy_share=0.9)
    got = {(r["doc_id"], r["pass"]) for r in draws.collect()}
    expected = set()
    for w in weights.collect():
        left = w["quota"]
        for p in range(math.ceil(w["quota"] / w["tokens"])):
            hashed = docs.where(F.col("source").eqNullSafe(F.lit(w["source"]))).select("doc_id", F.xxhash64(F.lit(mixing.SEED), F.lit(p), "doc_id").alias("h"))
            for r in sorted(hashed.collect(), key=lambda r: r["h"] % 2**64):
                if rows[r["doc_id"]][1] <= left:
                    left -= rows[r["doc_id"]][1]
                    expected.add((r["doc_id"], p))
    assert got == expected
    assert all((i, 0) in got for i, (s, n) in enumerate(rows) if n == 40)


@pytest.mark.parametrize("key", [None, 7])
def test_no_key_fills_a_bucket(spark, make_docs, monkeypatch, key):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "before", lambda rows, *a, before=mixing.before: sizes.append(rows.groupBy("source", "pass", "bucket").count().agg(F.max("count")).first()[0]) or before(rows, *a))
    sizes = []
    docs = make_docs([(key if i % 3 else i, f"w{i} " * (1 + i % 9), "en", "web") for i in range(1200)])
    draws, _ = mixing.mix(spark, docs, 1.0)
    assert draws.count() == 1200 and draws.select("row").distinct().count() == 1200
    assert max(sizes) < 60
    again, _ = mixing.mix(spark, docs.repartition(5), 1.0)
    assert sorted(map(str, again.collect())) == sorted(map(str, draws.collect()))


def test_covering_budget_leaves_no_row_out(spark, make_docs):
    docs = mixed_docs(make_docs)
    draws, _ = mixing.mix(spark, docs, None, 0.9, 4.0)
    times = collections.Counter(r["doc_id"] for r in draws.collect())
    assert len(times) == docs.count() and max(times.values()) <= 4


# 10: SentencePiece


def test_ids_are_the_librarys():
    rng = random.Random(10)
    bits = [" ", "  ", "\n", "▁", "a", "the", "ing", ".com", "é", "日", "🎉", "0", "'s", "\t", "(", "//", "=", "<s>", "tion", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 80))) for _ in range(1500)] + ["ab" * 5000, " " * 3000, "x" * 4000]
    ids, decoded = pieces.encode_texts(texts, piece_model(), "texts")
    sp = pieces.codec(piece_model()).library
    assert [x.tolist() for x in ids] == sp.encode(texts, add_bos=True, add_eos=True) and decoded == [sp.decode(x.tolist()) for x in ids]


def test_both_agendas_are_the_same():
    c = pieces.codec(piece_model())
    rng = random.Random(11)
    words = ["".join(rng.choices("▁abcdeinrst.é日", k=rng.randint(1, 50))) for _ in range(3000)]
    assert c.encode_words(words) == {w: c.ids_of(c.merged(w)) for w in words}


def test_remembered_stretches_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    monkeypatch.setattr(pieces, "PART", 300)
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choices("abei日🎉", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    c = pieces.PieceCodec(piece_model())
    monkeypatch.setitem(pieces._PROCESSORS, piece_model(), c)
    ids, _ = pieces.encode_texts(texts, piece_model())
    assert [x.tolist() for x in ids] == c.library.encode(texts, add_bos=True, add_eos=True) and len(c.words) <= 300


def test_long_texts_in_parts_are_the_same(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choices(["a", "the", " ", "  ", "▁", "é", "1", "\n", "日本", "token"], k=400)) for _ in range(60)] + [" " * 300, "a" * 300]
    column = pa.array(texts)
    model = language.train(["the a token"] * 5 + ["é é ka"] * 5, ["en"] * 5 + ["fr"] * 5)
    whole = style.read(column)
    labels = [language.label_texts(model, pa.array([t]))[:2] for t in texts]
    monkeypatch.setattr(pieces, "PART", 7)
    monkeypatch.setattr(style, "CHUNK", 13)
    cut = style.read(column)
    assert (whole.line_counts == cut.line_counts).all() and (whole.counts == cut.counts).all()
    assert whole.counts.sum() == sum(len(t.encode()) for t in texts)
    pieces.encode_texts(texts, piece_model(), "texts")
    own = language.cuts_between_runs
    monkeypatch.setattr(language, "cuts_between_runs", lambda raw: own(raw, 11))
    assert [language.label_texts(model, pa.array([t]))[0] for t in texts] == [x for x, _ in labels]
    assert all(np.allclose(language.label_texts(model, pa.array([t]))[1], s, atol=1e-4) for t, (_, s) in zip(texts, labels))
    together = language.label_texts(model, column)
    assert together[0] == [x[0] for x, _ in labels] and np.allclose(together[1], [s[0] for _, s in labels], atol=1e-4)


def test_whole_texts_are_compared_where_all_stretches_are_known(monkeypatch):
    c = pieces.PieceCodec(piece_model())
    monkeypatch.setitem(pieces._PROCESSORS, piece_model(), c)
    text = "the tea is the thing that tells"
    pieces.encode_texts([text, None, ""], piece_model())
    pieces.encode_texts([text], piece_model())
    joined = c.stretches
    monkeypatch.setattr(c, "stretches", lambda texts: [x[:-4] for x in joined(texts)])
    with pytest.raises(pieces.DifferentIds):
        pieces.encode_texts([text], piece_model())


def test_a_difference_is_an_error(monkeypatch):
    c = pieces.PieceCodec(piece_model())
    monkeypatch.setitem(pieces._PROCESSORS, piece_model(), c)
    del c.rank["▁the"]
    with pytest.raises(pieces.DifferentIds):
        pieces.encode_texts(["the tea is the thing that tells"], piece_model())


# The pipeline


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_classifier", "jaccard_join", "secret_scans", "temperature_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    kept = p.quality_classifier(spark, docs, SF)
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_quality_classifier"](spark, SF).collect()}
    one = rows(kept)
    assert kept.columns == docs.columns and set(one) == {i for i, s in scores.items() if s}
    two = rows(p.jaccard_join(spark, kept, SF))
    assert set(two) == {root for _, root in components_of([(i, r["text"]) for i, r in one.items()]).values()}
    third = p.secret_scans(spark, docs, SF)
    originals = rows(docs)
    for i, r in rows(third).items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in spans_of(originals[i]["text"]).split(",") if s]
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += originals[i]["text"][at:a] + "[secret]"
            at = max(at, b)
        assert r["text"] == out + originals[i]["text"][at:]
    fourth = p.temperature_mixing(spark, docs, SF)
    assert fourth.columns == docs.columns and set(rows(fourth)) == set(originals)
    last = p.run(spark, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and {r["doc_id"] for r in last.collect()} == set(two)


def test_style_handles_every_line(spark):
    t = style.read(pa.array(["a\nb\n", "", None, "x"]))
    assert np.diff(t.line_at).tolist() == [3, 1, 1, 1] and t.line_words.tolist() == [1, 1, 0, 0, 0, 1]


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op4_secret_scans"])
def test_same_as_sql(spark, name):
    import duckdb

    from sieveline.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()) == sorted(want.fetchall())


def test_blocks_and_chunks_do_not_change_matches(spark, monkeypatch):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    found = lambda: sorted(tuple(r) for r in chroma.search(spark, vectors, "vec_id", "embedding", F.col("vec_id") % 10 == 0, chroma.melody).collect())
    whole = found()
    monkeypatch.setattr(chroma, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(chroma, "VOTES", 7)
    monkeypatch.setattr(chroma, "SAMPLES_BYTES", 3000)
    assert found() == whole and sum(r[1] == "match" for r in whole) >= 50
    plan = chroma.search(spark, vectors, "vec_id", "embedding", F.col("vec_id") % 10 == 0, chroma.melody)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("classes") <= 2 and "Union" in plan  # one scan for members, one for any number of blocks


def test_no_key_fills_a_shard(spark, make_docs, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "SHARD_BYTES", 2000)
    docs = make_docs([(None if i % 2 else 5, "the same text in all rows", "en", "s") for i in range(2000)])
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256, 128).collect()
    texts = collections.Counter()
    for r in rows:
        texts[r["shard"]] += len(r["keys"])
    assert sum(texts.values()) == 2000 and len(texts) == 25 and max(texts.values()) < 200


def test_recurring_lines_against_plain_counts(spark, make_docs):
    rng = random.Random(15)
    common = ["sign up for news", "über uns", "all rights reserved"]
    texts = []
    for i in range(60):
        own = [f"line {i} {j} of its own" for j in range(6)]
        for line in common:
            if rng.random() < 0.5:
                own.insert(rng.randrange(len(own) + 1), line)
        texts.append("\n".join(own))
    texts += [texts[0]] * 30 + [texts[1].replace("1 3", "1 x")] * 20 + [None, "", "\n\n"]  # copies bring no new contexts
    around, times = collections.defaultdict(set), collections.Counter()
    for t in texts:
        own = (t or "").split("\n") if t is not None else []
        for j, line in enumerate(own):
            around[line].add((own[j - 1] if j else None, own[j + 1] if j + 1 < len(own) else None))
            times[line] += 1
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    import xxhash

    key = {line: int(np.uint64(xxhash.xxh64_intdigest(line.encode(), 42)).astype(np.int64)) for line in around if line}
    asked = spark.createDataFrame([(k,) for k in key.values()], "key bigint")
    got = {r["key"] for r in lines.recurring(docs, asked, "text", 3).collect()}
    want = {line for line in key if len(around[line]) >= 3 and len(around[line]) >= 0.5 * times[line]}
    assert got == {key[line] for line in want} and 0 < len(want) <= 3
    model = lines.learn(docs)
    assert set(model.lexicon.tolist()) <= {int(h) for line in want for h in words.word_hashes(pa.array([line]), fold=False)[0]}


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality_rules"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.02 and len(bad) > 20


def test_no_stretch_is_remembered_twice(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 400)
    rng = random.Random(14)
    c = pieces.PieceCodec(piece_model())
    turned = 0
    for _ in range(60):
        texts = ["the tea is " + " ".join("".join(rng.choices("abeird", k=rng.randint(1, 4))) for _ in range(60))]
        before = c.words
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in c.encode(texts)] == c.library.encode(texts)
        turned += c.words is not before
        assert not c.words.keys() & c.old_words.keys() and len(c.words) <= 400 and len(c.old_words) <= 400
    assert turned > 2


def test_a_worker_keeps_nothing_for_another_operator(monkeypatch):
    from pyspark import cloudpickle

    from sieveline.llm import shared

    monkeypatch.setitem(pieces._PROCESSORS, piece_model(), pieces.PieceCodec(piece_model()))
    monkeypatch.setitem(packing._ENCODERS, "ranks", object())
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["a"])
    sent = lambda owner: cloudpickle.loads(cloudpickle.dumps(shared.trimmed(lambda batches: batches, owner)))(iter([batch]))
    assert list(sent("pieces")) == [batch] and piece_model() in pieces._PROCESSORS and not packing._ENCODERS
    assert list(sent("")) == [batch] and not pieces._PROCESSORS
    pieces.encode_texts(["the tea"], piece_model())  # and it is made anew


def test_scores_do_not_depend_on_how_many_texts_are_counted_together(monkeypatch, make_docs):
    docs = make_docs([(i, "Some words of one text, and | more ! " * (i % 7) + "\n" * (i % 3), "en", "s") for i in range(60)]).repartition(1)
    rng = np.random.default_rng(3)
    model = quality.train(rng.random((40, quality.FEATURES)), rng.random((40, quality.FEATURES)), 0.5)
    whole = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    monkeypatch.setattr(quality, "TOGETHER", 200)
    cut = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert cut.keys() == whole.keys() and len(whole) == 60 and all(np.isclose(cut[i], whole[i], atol=1e-9) for i in whole)
    assert quality.keep(docs, model).count() == sum(s >= quality.THRESHOLD for s in whole.values())
