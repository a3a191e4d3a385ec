import random

import numpy as np
import pytest

from tickloom.llm import leakage as lk

ITEM = "The night desk moved a quiet ledger before dawn, said the new hire. Nobody watched the archive queue while it looked loose and spare. Of nine cases, four came from one price plan and the rest from the zorblat test."


def words(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ITEM.lower().replace(",", "").replace(".", "").split() * 4
    return [rnd.choice(vocab) for _ in range(n)]


def found(spark, docs, items=((7, ITEM),), **kw):
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id bigint, text string, coverage string")
    i = spark.createDataFrame(list(items), "item_id bigint, item_text string")
    return {(r["item_id"], r["doc_id"]) for r in lk.leaks(d, i, **kw).collect()}


def test_dress(spark):
    filler = " ".join(words(1, 80))
    first, second, third = ITEM.split(". ")
    docs = [
        (1, f"{filler}. {ITEM} {filler}"), (2, filler + "\n> " + ITEM.upper().replace(" ", "  ")), (3, f"<p>{first}.</p>\n{filler}\n<b>{third}</b>"), (4, f"{filler} {first}. {filler}"), (5, filler),
        (6, ITEM.replace("ledger", "ledegr").replace("queue", "qeueu").replace("rest", "remainder")), (7, filler + " " + ITEM.replace("archive", "arch-\nive")), (8, None), (9, ""), (10, ITEM), (11, ITEM),
        (12, " ".join(w for s in ITEM.split() for w in (s, random.Random(3).choice(["aa", "bb"])))), (13, " ".join(random.Random(2).sample(ITEM.split(), len(ITEM.split())))),
    ]
    assert found(spark, docs) == {(7, k) for k in (1, 2, 3, 6, 7, 10, 11)}


def brute_coverage(item, sentences, document, gap=lk.GAP, agree=lk.AGREE):
    """Every common subsequence with limited gaps, place by place: the longest that ends there, of these the first in the item, then the last in the document."""
    best, marked = {}, set()
    for i, w in enumerate(item.tolist()):
        for j, x in enumerate(document.tolist()):
            if w != x:
                continue
            before = [best[i - a, j - b] for a in range(1, gap + 1) for b in range(1, gap + 1) if (i - a, j - b) in best]
            n, a, b = max(before, default=(0, -i, j))
            best[i, j] = (n + 1, a, b)
            n, a, b = n + 1, -a, b
            long = i - a + 1 >= lk.STRETCH or any(a <= s and e <= i + 1 for s, e in sentences)
            if long and n >= lk.MATCHES and n >= agree * (i - a + 1) and n >= agree * (j - b + 1):
                marked |= set(range(a, i + 1))
    return len(marked) / len(item)


def test_alignment_against_brute_force():
    rnd = random.Random(4)
    items = [np.array([rnd.randrange(9) for _ in range(rnd.randrange(1, 40))], np.int32) for _ in range(12)]
    sentences = [[(0, len(i) // 2), (len(i) // 2, len(i))] if len(i) > 1 else [(0, 1)] for i in items]
    docs = []
    for k in range(30):
        d = [rnd.randrange(-1, 9) for _ in range(rnd.randrange(0, 60))]
        w = items[k % 12].tolist()
        cut = rnd.randrange(len(w) + 1)
        d[len(d) // 2 : len(d) // 2] = [x for x in w[cut:] if rnd.random() < 0.9] + [-1] * rnd.randrange(3) + w[:cut]
        docs.append(np.array(d, np.int32))
    at = [(i, d) for d in range(30) for i in range(12)]
    for cells in (50, 2_000_000):
        got = lk.coverages(items, sentences, docs, np.array([i for i, _ in at]), np.array([d for _, d in at]), cells=cells)
        assert np.allclose(got, [brute_coverage(items[i], sentences[i], docs[d]) for i, d in at])
    assert (got > 0.5).any() and (got == 0).any() and len(lk.coverages([], [], [], np.empty(0, np.int64), np.empty(0, np.int64))) == 0


QUESTIONS = "ledger dawn archive queue price plan desk margin harbour signal copper lantern orchard velvet thunder meadow granite whistle pepper canyon saddle ribbon falcon marble timber".split()


def test_recall_of_paraphrases_against_exhaustive_search(spark):
    """Items told in other words: another order, a third of the words replaced, no ten words in a row kept. What all pairs of exact TF-IDF passages find, the clustered latent search finds to nine tenths."""
    rnd = random.Random(12)
    vocabulary = QUESTIONS + [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rnd.sample(vocabulary, 24)), f"Answer {k} is zz{k}") for k in range(60)]
    docs = []
    for k in range(240):
        w = [rnd.choice(vocabulary + [f"o{j}" for j in range(400)]) for _ in range(72)]
        if k % 2:
            said = [x for x in items[k % 60][1].split()]
            rnd.shuffle(said)
            w[24:48] = [x if rnd.random() < 0.8 else f"o{rnd.randrange(400)}" for x in said]
            w[60:60] = f"answer {k % 60} is zz{k % 60}".split() if k % 3 else []
        docs.append((k, " ".join(w)))
    frame = spark.createDataFrame(items, "item_id bigint, item_text string, answer string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    held = lk.read_items(frame, answer="answer")
    numbers = spark.createDataFrame([(i, [held.vocabulary.get(w, -1) for w in lk.words(t)]) for i, t in docs], "doc_id bigint, numbers array<int>")
    idf, basis = lk.latent_basis(numbers, held.size, rank=120)
    exact = lk.item_index(held, idf, np.eye(held.size))
    latent = lk.item_index(held, idf, basis)
    rows = numbers.collect()
    flat, lengths = np.concatenate([np.array(r[1], np.int32) for r in rows]), np.array([len(r[1]) for r in rows])
    pairs = lambda index, probes: {(int(a), int(b)) for a, b, c in zip(*lk.candidates(flat, lengths, index, lk._weighted(index.idf, index.basis), 0.7, probes))}
    want, got = pairs(exact, 10_000), pairs(latent, lk.PROBES)
    assert len(want) >= 100 and len(want & got) >= 0.9 * len(want)
    out = lk.leaks(d, frame, answer="answer", rank=120, paraphrase=0.7).collect()
    told = {(r["item_id"], r["doc_id"]) for r in out if r["kind"] == "paraphrase"}
    planted = {(k % 60, k) for k in range(240) if k % 2 and k % 3}
    assert told <= planted and len(told) >= 0.9 * len(planted)
    assert {r["kind"] for r in lk.leaks(d, frame, rank=120, paraphrase=0.7).collect()} <= {"wording"}


def test_items_in_groups_give_the_same(spark):
    items = [(k, " ".join(words(100 + k, 45))) for k in range(20)]
    docs = [(k, " ".join(words(50 + k, 30)) + " " + items[k][1]) for k in range(20)]
    assert found(spark, docs, items, item_words=200) == found(spark, docs, items) == {(k, k) for k in range(20)}


def test_very_long_text_and_many_items(spark):
    items = [(k, " ".join(words(100 + k, 45))) for k in range(20)] + [(50, None), (51, ""), (52, "!?")]
    long = " ".join(words(5, 60_000))
    docs = [(1, long[:150_000] + " " + items[3][1] + " " + long[150_000:]), (2, items[4][1] + " x " + items[5][1]), (3, long)]
    assert found(spark, docs, items) == {(3, 1), (4, 2), (5, 2)}


def test_empty(spark):
    assert found(spark, []) == set() and found(spark, [(1, ITEM)], []) == set()


def test_recall_of_the_index_against_brute_force(spark):
    """The latent search finds what exhaustive alignment finds, with a basis of few dimensions fitted on a part of the passages."""
    rnd = random.Random(9)
    items = [(k, " ".join(words(200 + k, 50))) for k in range(12)]
    docs = []
    for k in range(120):
        w = words(1000 + k, 150)
        if k % 2:
            source, at = items[k % 12][1].split(), rnd.randrange(100)
            w[at:at] = source[: rnd.choice([28, 36, 50])]
        docs.append((k, " ".join(w)))
    held = lk.read_items(spark.createDataFrame(items, "item_id bigint, item_text string"))
    num = {w: held.vocabulary[w] for w in held.vocabulary}
    want = set()
    for d, t in docs:
        doc = np.array([num.get(w, -1) for w in lk.words(t)])
        want |= {(i, d) for i, w, s in zip(held.ids, held.words, held.sentences) if brute_coverage(w, s, doc) >= lk.LEAKED}
    got = found(spark, docs, items, rank=64, fit_passages=400)
    assert got <= want and len(want) >= 55 and len(got) >= 0.9 * len(want)


def test_randomised_basis_spans_the_leading_vectors(spark):
    docs = [(k, " ".join(words(k, 120))) for k in range(200)]
    held = lk.read_items(spark.createDataFrame([(k, " ".join(words(900 + k, 60))) for k in range(10)], "item_id bigint, item_text string"))
    rows = [(i, [held.vocabulary.get(w, -1) for w in lk.words(t)]) for i, t in docs]
    idf, basis = lk.latent_basis(spark.createDataFrame(rows, "doc_id bigint, numbers array<int>"), held.size, rank=20, powers=4)
    m = np.concatenate([lk.blocks(np.array(n), np.array([len(n)]), 24)[0] for _, n in rows])
    a = np.zeros((len(m), held.size + 1))
    np.add.at(a, (np.arange(len(m))[:, None], m), 1)
    a = a[:, :-1] * idf
    a /= np.maximum(np.sqrt((np.append(idf, 0)[m] ** 2).sum(1)), 1e-9)[:, None]
    best = np.linalg.svd(a)[1][:20]
    assert (np.linalg.norm(a @ basis) ** 2) >= 0.93 * (best**2).sum()
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)


def test_numbers_are_those_of_the_words():
    rnd = random.Random(1)
    vocabulary = {w: k for k, w in enumerate(["cafes", "report", "dont", "a", "1", "straße", "naive", "東京", "ledger"])}
    texts = [None, "", "Cáfe​'s <b>Re-\nport</b> &amp; Don’t", "東京 naïve STRASSE straße ½ x_a a_1 _a_ 'a'", "\n\n", "ledger" * 3 + " ledger"]
    texts += ["".join(rnd.choice("aA1 _-\n'é<>&;bﬁÅ東京") for _ in range(rnd.randrange(60))) for _ in range(300)]
    flat, lengths = lk.numbers_of(texts, *lk._lookup(vocabulary))
    want = [[vocabulary.get(w, -1) for w in lk.words(t or "")] for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]
    assert lk.numbers_of(["a b"], *lk._lookup({"z": 0}))[0].tolist() == [-1, -1]


def test_blocks_and_hyphens():
    rows, own = lk.blocks(np.arange(7), np.array([3, 0, 4]), 2)
    assert rows.tolist() == [[0, 1], [2, -1], [3, 4], [5, 6]] and own.tolist() == [0, 0, 2, 2]
    assert lk.words("Cáfe​'s <b>Re-\nport</b> &amp; Don’t") == ["cafes", "report", "dont"]


@pytest.mark.parametrize("cut,leak", [(0.6, True), (0.35, False)])
def test_share_of_words(cut, leak):
    w = np.arange(60)
    assert (lk.coverage(w, [(0, 60)], np.concatenate([np.full(30, -1), w[: int(60 * cut)], np.full(5, -1)])) >= lk.LEAKED) == leak
