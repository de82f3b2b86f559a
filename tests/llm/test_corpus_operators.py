"""Decontamination, disclosure, models, the Jaccard join, archives and the pipeline."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import COLUMNS, EDGE, SAME, documents, edge
from pyspark.sql import functions as F

from motionmatch.llm import decontamination as dc
from motionmatch.llm import disclosure, factorisation, jaccard_join, language_codes, warc
from motionmatch.llm.queries import fold

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def prose(rng, n, size=400):
    words = ["w" + "".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(size)]
    return " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(size)], k=n))


# ---------------------------------------------------------------- decontamination


def brute_scores(index, terms):
    scores = defaultdict(float)
    for t in terms:
        for unit, w in zip(index.docs[t], index.weights[t]):
            scores[unit] += w
    return scores


def index_of(texts, search):
    items = [(k, *dc.question_answer(t, None, None)) for k, t in enumerate(texts)]
    units = [u for _, q, a in items for u in dc.units_of(dc.all_words(q, a), search.unit)]
    frequency = Counter(t for u in units for t in set(u))
    return dc.Index(items, search, len(units), sum(map(len, units)) / len(units), frequency)


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6])
def test_wand_finds_all_units_above_the_threshold(threshold):
    rng = random.Random(2)
    search = dc.Search(unit=12, threshold=threshold, block=4)
    index = index_of([prose(rng, rng.randint(5, 40), 60) for _ in range(120)], search)
    for _ in range(150):
        terms = sorted(rng.sample(range(len(index.docs)), min(len(index.docs), rng.randint(1, 30))))
        want = {u: s for u, s in brute_scores(index, terms).items() if s >= threshold - 1e-9}
        got = index.above(terms)
        assert len(got) == len(dict(got)) and dict(got) == pytest.approx(want)


def brute_matches(text, index):
    """Every passage against every unit, then the verification."""
    search, words = index.search, dc.words_of(text)
    out = {}
    for k in range(max(1, -(-len(words) // search.unit))):
        terms = {index.term[w] for w in words[k * search.unit:(k + 2) * search.unit] if w in index.term}
        for unit, score in brute_scores(index, terms).items():
            if score < search.threshold - 1e-9:
                continue
            item = index.item[unit]
            reach = sum(map(len, index.parts[item]))
            shares = index.verified(item, words[max(0, k * search.unit - reach):(k + 2) * search.unit + reach])
            best = out.get(item, (0, (0, 0)))
            out[item] = max(best[0], score), max(best[1], shares, key=min)
    return {i: (s, *v) for i, (s, v) in out.items() if v[0] >= search.question and v[1] >= search.answer}


@pytest.mark.parametrize("search", [dc.Search(), dc.Search(unit=10, threshold=0.35, question=0.0, answer=0.0, block=3)])
def test_matches_are_those_of_brute_force(spark, search):
    items = [r.text for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts += ["", f"before {items[3]} after", " ".join(items[5].split()[:8]), items[7].upper()]
    index = index_of(items, search)
    got = defaultdict(dict)
    for row, item, score, q, a in dc.matches(texts, index):
        got[row][item] = pytest.approx((score, q, a))
    for k, t in enumerate(texts):
        assert brute_matches(t, index) == got.get(k, {})


def test_planted_items_are_found_and_others_are_not(spark):
    rng = random.Random(4)
    items = [prose(rng, n) + ". " + prose(rng, 6) + "." for n in (20, 45, 150, 3)]
    whole = [f"{prose(rng, 300)} {i} {prose(rng, 200)}" for i in items]
    changed = " ".join("other" if k % 17 == 16 else w for k, w in enumerate(items[2].split()))
    without_end = prose(rng, 80) + " " + items[2].rsplit(". ", 1)[0]     # an excerpt is contaminated, too
    clean = [prose(rng, 500) for _ in range(20)]
    docs = documents(spark, *whole, changed, without_end, *clean)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    assert got >= {(0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 2)} and all(d <= 5 for d, _ in got)
    small = dc.Search(shard_words=60)                        # several indexes, the same findings
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench, small).collect()} == got
    assert {r.doc_id for r in dc.decontaminated(docs, bench).collect()} == set(range(6, 26))


@pytest.mark.parametrize("size", [8, 10, 15, 19, 20, 43, 48, 60, 100, 150])
def test_excerpts_of_three_fifths_are_found(spark, size):
    rng = random.Random(size)
    words = prose(rng, size).split()
    long = -(-3 * size // 5)
    whole = " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))
    cut = whole.split()
    texts = [f"{prose(rng, 120)} {' '.join(cut[a:a + long])} {prose(rng, 90)}" for a in range(0, size - long + 1, max(1, size // 12))]
    third = [f"{prose(rng, 120)} {' '.join(cut[a:a + size // 3])} {prose(rng, 90)}" for a in range(0, size - size // 3, max(1, size // 4))]
    docs = documents(spark, *texts, *third)
    bench = spark.createDataFrame([(k, whole if not k else prose(rng, size)) for k in range(20)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()) == [(k, 0) for k in range(len(texts))]


def test_question_and_answer_columns(spark):
    bench = spark.createDataFrame(
        [("q", "what is the capital city of the small country", "the capital is called vaduz")],
        "item_id string, question string, answer string")
    docs = documents(spark, "so what is the capital city of the small country well the capital is called vaduz",
                     "so what is the capital city of the small country well nobody here ever knew it")
    assert [(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()] == [(0, "q")]


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, SAME), (2, None), (None, ""), (3, SAME), (4, "word")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(edge(spark), bench).collect()}
    assert got == {(d, i) for d in (None, 4, 5) for i in (1, 3)} | {(7, 4)}
    kept = dc.decontaminated(edge(spark), bench)
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE) - 5
    assert dc.contaminated(edge(spark).limit(0), bench).count() == 0
    assert dc.contaminated(edge(spark), bench.limit(0)).count() == 0
    assert dc.decontaminated(edge(spark), bench.limit(0)).count() == len(EDGE)


# ---------------------------------------------------------------- disclosure


def base_private(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("a1.@+-_ ()é\n", weights=[3, 6, 4, 2, 1, 1, 1, 2, 1, 1, 1, 1], k=rng.randint(5, 160)))
             for _ in range(1500)]
    texts += ["x@y a@b@c.de_f@g.hi", "001.002.0255.3 1.2.3.4.5 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
              "\U0001f600é a@b.co +1 (222) 555-0100 ext", "7" * 30_000, "1.2.3.4 " * 3000, "a" * 50_000]
    got = {r.doc_id: r for r in disclosure.sanitised(documents(spark, *texts)).collect()}
    for k, t in enumerate(texts):
        assert [(s.start, s.order, s.end, s.kind) for s in got[k].base_spans] == base_private(t), t[:100]
        base = [s for s in got[k].spans if s.kind != "term"]
        assert [(s.start, s.end) for s in base] == [(s.start, s.end) for s in got[k].base_spans]


def brute_terms(texts, limits):
    """doc -> spans of disclosing terms, from the definitions."""
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)] for t in texts]
    total, every = sum(map(len, words)), Counter(w for row in words for _, _, w in row)
    both, seen, held = Counter(), defaultdict(set), defaultdict(set)
    once, every_once = Counter(), Counter()               # the same over distinct texts
    for d, t in enumerate(texts):
        spans = base_private(t)
        for k, (a, _, b, kind) in enumerate(spans):
            name = kind, re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()
            held[d].add(name)
            before = spans[k - 1][2] if k else 0
            after = spans[k + 1][0] if k + 1 < len(spans) else len(t)
            left = re.findall(r"[^\W_]+", t[before:a].lower())[-limits.window:]
            right = re.findall(r"[^\W_]+", t[b:max(b, after)].lower())[:limits.window]
            for w in left + right:
                both[name, w] += 1
                once[name, w] += t not in texts[:d]
                seen[name, w].add((tuple(left), tuple(right)))
        every_once.update(w for _, _, w in words[d] if t not in texts[:d])
    content = {n: -math.log2(sum(c for (m, _), c in both.items() if m == n) / total) for n in {n for n, _ in both}}
    found = {(n, w) for (n, w), c in both.items() if len(seen[n, w]) >= limits.min_contexts
             and 1 + math.log2(min(1, c / every[w])) / content[n] >= limits.generalise_at}
    z = limits.deviations
    for (n, w), c in once.items():
        if len(seen[n, w]) < limits.min_contexts:
            share = min(1, c / every_once[w])
            cases = len(seen[n, w]) / share
            chance = sum(x for (m, _), x in once.items() if m == n) / sum(every_once.values())
            bound = (share + z * z / (2 * cases) - z * math.sqrt(share * (1 - share) / cases + z * z / (4 * cases * cases))) / (1 + z * z / cases)
            if chance < 1 and (bound - chance) / (1 - chance) >= limits.single_at:
                found.add((n, w))
    out = {}
    for d, t in enumerate(texts):
        taken = base_private(t)
        out[d] = {(a, b) for a, b, w in words[d] if any((n, w) in found for n in held[d])
                  and not any(x < b and y > a for x, _, y, _ in taken)}
    return out


def test_terms_that_disclose_an_entity(spark):
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(80)]
    for k in range(4):                                        # a rare nickname beside one address, in different contexts
        texts.append(f"{prose(rng, 30)} {prose(rng, 3)} Zorblax wrote boss@example.com {prose(rng, 30)} 1234 Zorblax")
    texts += [texts[-1]] * 5 + ["Zorblax was seen again without an address", None]
    limits = disclosure.Disclosure(generalise_at=0.7, remove_at=0.97)
    got = {r.doc_id: r for r in disclosure.sanitised(documents(spark, *texts), limits).collect()}
    want = brute_terms([t or "" for t in texts], limits)
    assert any(want.values())
    for k, t in enumerate(texts):
        assert {(s.start, s.end) for s in got[k].spans if s.kind == "term"} == want[k]
        assert got[k].spans == sorted(got[k].spans, key=lambda s: (s.start, s.order))
    assert "boss@" not in got[80].clean_text and "[EMAIL]" in got[80].clean_text and "Zorblax" not in got[80].clean_text
    assert got[len(texts) - 2].clean_text == texts[-2] and got[len(texts) - 1].clean_text is None
    assert got[0].clean_text == texts[0]


def test_disclosure_edge_cases(spark):
    rows = disclosure.sanitised(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if r.doc_id in (4, 5):
            assert [s.kind for s in r.base_spans] == ["email", "phone"] and "a.b@" not in r.clean_text
        elif r.doc_id is not None:
            assert not r.spans
    assert disclosure.sanitised(edge(spark).limit(0)).count() == 0
    plan = disclosure.sanitised(edge(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- factorisation machine


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    weights, factors = rng.normal(size=50), rng.normal(size=(50, 4))
    cols, x, starts = rng.integers(0, 50, 30), rng.normal(size=30), np.array([0, 12, 13, 30])
    got, _ = factorisation.margin(0.5, weights, factors, cols, x, starts)
    for k in range(3):
        a, b = starts[k:k + 2]
        want = 0.5 + sum(weights[cols[i]] * x[i] for i in range(a, b)) + sum(
            factors[cols[i]] @ factors[cols[j]] * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[k] == pytest.approx(want)


def test_the_machine_learns_an_interaction():
    """Label 1 if exactly one of two words is there: no linear model separates it."""
    rng = random.Random(6)
    texts, labels = [], []
    for _ in range(400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["x"] * 3 + ["alpha"] * a + ["beta"] * b + ["gamma"] * (not a) + ["delta"] * (not b)))
        labels.append(float(a != b))
    rows = factorisation.features(texts, [None] * 400, factorisation.Buckets())
    machine = factorisation.fitted(*rows, np.array(labels), factorisation.Fit(epochs=60))
    assert np.mean((machine.scores(*rows) >= 0.5) == np.array(labels)) > 0.97


def top_word_share(text):
    values = factorisation.features([text], [len(text)], factorisation.Buckets())[1]
    return values[-len(factorisation.STATISTICS):][factorisation.STATISTICS.index("top_word_share")]


def test_top_word_share_covers_the_whole_text():
    clean = " ".join(f"w{k}" for k in range(2500))
    assert top_word_share(clean) == pytest.approx(1 / 2500)
    assert top_word_share(clean + " spam" * 2500) == pytest.approx(0.5)
    assert top_word_share("a b c d e f g h i j k k") == pytest.approx(2 / 12) and top_word_share("") == 0


@pytest.mark.parametrize("fit", [factorisation.Fit()])
def test_quality_on_held_out_documents(spark, fit):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    machine = factorisation.taught(docs, labels, fold(5) != 0, fit)
    rows = factorisation.quality_scores(docs, machine).join(labels, "doc_id").where(fold(5) == 0).collect()
    good = [r.score >= 0.3 for r in rows if r.quality == 1]
    bad = [r.score >= 0.3 for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    other = {r.doc_id: r.score for r in factorisation.quality_scores(changed, machine).collect()}
    assert all(other[r.doc_id] == r.score for r in rows)


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, None), (3, 1), (4, 0), (5, 1), (5, 0), (None, 1), (99, 1)], "doc_id bigint, quality int")
    machine = factorisation.taught(edge(spark), labels, F.lit(True), factorisation.Fit(epochs=3))
    rows = factorisation.quality_scores(edge(spark), machine).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert factorisation.good_enough(edge(spark), machine, 0.0).columns == edge(spark).columns
    for some, want in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 0.999)):
        machine = factorisation.taught(edge(spark), some, F.lit(True), factorisation.Fit())
        assert {round(r.score, 3) for r in factorisation.quality_scores(edge(spark), machine).collect()} == {want}
    assert factorisation.quality_scores(edge(spark).limit(0), machine).count() == 0


# ---------------------------------------------------------------- language codes


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = language_codes.codewords(n, 1)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


def test_decoding_survives_wrong_bits():
    code = language_codes.codewords(5, 1)
    model = language_codes.Model(tuple("abcde"), code, np.eye(language_codes.WIDTH, code.shape[1]), np.zeros(code.shape[1]),
                                 np.full(code.shape, 1 / code.shape[1]), 0.15)
    for k in range(5):
        x = np.zeros((1, language_codes.WIDTH))
        x[0, :code.shape[1]] = code[k] * 3
        x[0, :3] *= -1                                        # three wrong bits of fifteen, at least eight apart
        best, score, unsure = model.judged(x)
        assert best[0] == k and 0 < score[0] < 1
        x[0, :code.shape[1]] = 0.001
        assert model.judged(x)[2][0]


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    known, text = language_codes.letters(), "Ein Satz, über zwei Zeilen\nund mehr 12 wörter. " * 20
    whole = language_codes.ngram_counts(text, known)
    monkeypatch.setattr(language_codes, "CHUNK", 7)
    assert (language_codes.ngram_counts(text, known) == whole).all() and whole.sum() > 1000


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = language_codes.taught(docs, fold(4) != 2)
    rows = language_codes.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold(4) == 2).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_language_edge_cases(spark):
    model = language_codes.taught(edge(spark), F.lit(True))
    assert model.languages == ("de", "en", "fr")
    rows = language_codes.languages(edge(spark), model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {None, 1, 2, 6}
    digits = language_codes.languages(documents(spark, "12 34 !!", "a"), model).orderBy("doc_id").collect()
    assert digits[0].lang_pred == "und" and digits[0].ambiguous and digits[1].lang_pred != "und"
    assert language_codes.languages(edge(spark).limit(0), model).count() == 0
    for docs, want in ((edge(spark).limit(0), "und"), (edge(spark).where("lang = 'de'"), "de")):
        model = language_codes.taught(docs, F.lit(True))
        assert language_codes.languages(documents(spark, "hello"), model).first().lang_pred == want
    with pytest.raises(ValueError):
        language_codes.taught(edge(spark), F.lit(True), language_codes.Fit(max_languages=2))


# ---------------------------------------------------------------- Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    links = [{j for j in range(len(texts)) if j != i and sets[i] and sets[j]
              and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9} for i in range(len(texts))]
    group = list(range(len(texts)))
    while True:
        new = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(texts))]
        if new == group:
            return [(i, group[i], len(links[i])) for i in range(len(texts))]
        group = new


def near_texts():
    rng = random.Random(21)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 120)} {passage} {prose(rng, 40)}" for _ in range(20)]
    for k in (3, 7, 60):
        words = texts[k].split()
        for _ in range(25):
            changed = list(words)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = "changed"
            texts.append(" ".join(changed))
    return texts + ["a b", "a b", "a  b\n", "", None, "  "]


@pytest.mark.parametrize("join", [jaccard_join.Join(), jaccard_join.Join(tile_rows=3), jaccard_join.Join(tile_shingles=400)])
def test_groups_are_those_of_brute_force(spark, join):
    texts = near_texts()
    got = jaccard_join.jaccard_groups(documents(spark, *texts), join).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_groups(texts)


def test_posterior_limits():
    for n, m in ((12, None), (48, None), (96, None)):
        least = jaccard_join.least_matches(n, 0.8, 1e-9)
        tail = lambda m: sum(math.comb(n + 1, j) * 0.8 ** j * 0.2 ** (n + 1 - j) for j in range(m + 1))
        assert tail(least) >= 1e-9 and (least == 0 or tail(least - 1) < 1e-9)
        grid = np.linspace(0, 1, 20001)[1:-1]                 # the same by integrating the posterior
        density = grid ** least * (1 - grid) ** (n - least)
        assert density[grid >= 0.8].sum() / density.sum() == pytest.approx(tail(least), rel=0.02)


def test_components_of_a_path_and_a_star(spark):
    name = lambda k: bytearray(hashlib.md5(str(k).encode()).digest())
    edges = [(name(k), name(k + 1)) for k in range(40)] + [(name(100), name(k)) for k in range(101, 160)] + [(name(7), name(7))]
    got = jaccard_join.components(spark.createDataFrame(edges, "digest binary, root binary")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[bytes(r.root)].add(bytes(r.node))
    path, star = ({bytes(name(k)) for k in ks} for ks in (range(41), range(100, 160)))
    assert {frozenset(g | {k}) for k, g in groups.items()} == {frozenset(path), frozenset(star)}
    assert set(groups) == {min(path), min(star)}


def test_join_edge_cases(spark):
    rows = jaccard_join.jaccard_groups(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    same = [r for r in rows if r.doc_id in (4, 5)]
    assert {(r.class_id, r.n_links) for r in same} == {(4, 3)}
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in rows if r.doc_id not in (None, 4, 5))
    kept = jaccard_join.one_of_each(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "6", "7", "8", "9"])
    assert jaccard_join.jaccard_groups(edge(spark).limit(0)).count() == 0
    assert jaccard_join.one_of_each(edge(spark).limit(0)).count() == 0
    twice = documents(spark, "a b c d e f", "x y").unionByName(documents(spark, "a b c d e f", "z"))
    assert Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(twice).collect()) == Counter(
        [(0, "a b c d e f"), (1, "x y"), (1, "z")])


# ---------------------------------------------------------------- archives


def page_frame(spark):
    big, small = "<p>" + "ü" * 80 + "</p>", "short"
    rows = [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://b\r\nX: y", small), (4, "http://c", small),
            (7, "http://d", None), (8, "http://e", ""), (None, "http://f", big), (2, "http://a/2", big), (10, "http://g", "x" * 300_000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))


def test_pages_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(page_frame(spark), path)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == 10
    html = {(r.page_id, r.url): (r.html or "").encode() for r in page_frame(spark).collect()}
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in rows)
    assert kinds["<urn:x-page:2>", "response", None] == 2
    for page in ("5", "9", "null"):
        assert kinds[f"<urn:x-page:{page}>", "revisit", "<urn:x-page:2>"] == 1
    for page in (3, 4, 7, 8, 10):
        assert kinds[f"<urn:x-page:{page}>", "response", None] == 1
    for r in rows:
        if r.record_type == "response":
            body = next(v for (k, _), v in html.items() if f"<urn:x-page:{k}>" == r.record_id)
            assert bytes(r.payload) == body and r.payload_length == len(body)
            assert r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    assert {r.target_uri for r in rows if r.record_id == "<urn:x-page:3>"} == {"http://b%0D%0AX: y"}
    assert warc.read_warc(spark, path).where("target_uri IS NULL").count() == 1


def test_predicates_reach_the_reader_and_payloads_are_skipped(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    warc.write_pages(page_frame(spark).repartition(1), path)
    frame = warc.read_warc(spark, path, "record_id string, record_type string").where("record_type = 'revisit'")
    assert frame.count() == 3
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter .*record_type", plan)      # judged by the reader alone
    assert warc.read_warc(spark, path).where("content_length > 250000 AND record_id LIKE '<urn:x-page:1%'").count() == 1
    assert warc.read_warc(spark, path).where("record_type IN ('revisit', 'metadata') OR record_id = 'x'").count() == 3
    taken = []
    inner = warc.Member.read
    monkeypatch.setattr(warc.Member, "read", lambda self, n: taken.append(n) or inner(self, n))
    ((name, size),) = warc.listed_files(path)
    with open(name, "rb") as file:
        assert len(list(warc.records(file, size, True, lambda h: h["warc-type"] == "revisit", True))) == 3
    assert sum(taken) < 40 * warc.HEAD                        # of 300,000 bytes


def test_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"", b"abc", b"\r\n\r\n", bytes(range(256)) * 40]
    parts = [record % (k, len(b), b) for k, b in enumerate(bodies)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "ignored.txt").write_bytes(b"nothing")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter((r.record_id, bytes(r.payload)) for r in rows) == Counter(
        {(f"<x:{k}>", b): 2 for k, b in enumerate(bodies)})
    some = warc.read_warc(spark, str(tmp_path), "record_id string").where("record_id = '<x:3>' OR record_id = '<x:1>'")
    assert some.count() == 4
    for bad in (parts[1][:-9], b"no record at all\r\n\r\n"):
        (tmp_path / "c.warc").write_bytes(bad)
        with pytest.raises(Exception, match="cut off|not a record"):
            warc.read_warc(spark, str(tmp_path / "c.warc")).collect()
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(parts[1] + parts[2]))
    with pytest.raises(Exception, match="more than one record"):
        warc.read_warc(spark, str(tmp_path / "d.warc.gz")).collect()


def test_only_committed_files_are_read(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_pages(page_frame(spark), str(path))
    (path / "lost.warc.gz").write_bytes(b"what a lost task left")
    assert warc.read_warc(spark, str(path)).count() == 10
    warc.write_pages(page_frame(spark).limit(1), str(path))   # appends
    assert warc.read_warc(spark, str(path)).count() == 11
    empty = tmp_path / "empty"
    warc.write_pages(page_frame(spark).limit(0), str(empty))
    assert warc.read_warc(spark, str(empty)).count() == 0
    data = b"x" * 1000
    assert zlib.decompress(warc.member(data), 31) == data


def test_copies_of_one_page_are_dealt_over_tasks(spark):
    same = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), F.col("id")).alias("url"),
                                    F.lit("a page that stands everywhere " * 5).alias("html"))
    other = spark.range(3000, 3050).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                           F.concat(F.lit("page " * 30), F.col("id")).alias("html"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tasks = warc.page_records(same.union(other)).groupBy(F.spark_partition_id().alias("task"), "record_type").agg(
            F.count("*").alias("n"), F.min("refers_to").alias("least"), F.max("refers_to").alias("most")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    again = [r for r in tasks if r["record_type"] == "revisit"]
    assert sum(r["n"] for r in again) == 2999 and sum(r["n"] for r in tasks) == 3050
    assert {r["least"] for r in again} == {r["most"] for r in again} == {"<urn:x-page:0>"}
    assert len(again) == 4 and max(r["n"] for r in again) < 1800


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.settled(stage(spark, docs, LARGER), "stage")
        at[name] = before.collect(), docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = at["quality classifier"]
    kept = {r.doc_id for r in after}
    assert np.mean([r.doc_id in kept for r in before if labels.get(r.doc_id) == 1]) > 0.97
    assert np.mean([r.doc_id in kept for r in before if labels.get(r.doc_id) == 0]) < 0.2
    before, after = at["n-gram Jaccard join"]
    groups = brute_groups([r.text for r in before])
    first = {}
    for (k, g, _), r in zip(groups, before):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = at["benchmark decontamination"]
    items = [r.text for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    index = index_of(items, dc.Search())
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not brute_matches(r.text, index)}
    before, after = at["secret scans"]
    texts = {r.doc_id: r.text for r in before}
    from motionmatch.llm import structures
    assert all(r.text == structures.masked(texts[r.doc_id], structures.secrets_in(texts[r.doc_id])) for r in after)
    before, after = at["SentencePiece encoding and decoding"]
    assert len(before) == len(after) and all(r.lossless and r.n_pieces == len(r.ids) for r in after)


def test_pipeline_stages_take_edge_cases(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, SAME)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for docs in (edge(spark), edge(spark).limit(0), spark.createDataFrame([], COLUMNS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_a_score_does_not_depend_on_neighbours():
    rng = random.Random(31)
    texts = [prose(rng, n) for n in (1, 7, 40, 300, 2000)] + ["", "a", "x y"]
    cols, values, starts = factorisation.features(texts, [None] * len(texts), factorisation.Buckets())
    labels = np.array([k % 2 for k in range(len(texts))], float)
    machine = factorisation.fitted(cols, values, starts, labels, factorisation.Fit(epochs=4))
    for text in texts:
        scores = set()
        for size in range(1, 40):
            batch = [prose(rng, rng.randrange(60)) for _ in range(size)]
            batch.insert(rng.randrange(size + 1), text)
            at = batch.index(text)
            scores.add(machine.scores(*factorisation.features(batch, [None] * len(batch), factorisation.Buckets()))[at].tobytes())
        assert len(scores) == 1, text[:40]
