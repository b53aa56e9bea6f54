import hashlib
import random
import string
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lexmill.llm import bytebpe, mixing, quality, secrets
from tests.llm import brute
from tests.llm.conftest import documents

WORDS = [f"{a}{b}{c}" for a in ("st", "r", "cl", "br", "m") for b in ("a", "ea", "ou", "i") for c in ("ne", "ver", "ld", "rt", "ck", "ll")]


def corpus(seed=7):
    """Prose, shouting and symbols with low labels, near copies, repeated rows and ids, secrets, nulls."""
    rng = random.Random(seed)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    letters = string.ascii_letters + string.digits
    rows, quality_of = [], {}

    def add(words, source=None, doc_id=0):
        d = len(rows) * 3 + 5 if doc_id == 0 else doc_id
        rows.append((d, " ".join(words), "en", source or rng.choice(["a", "b", "b", "c", "c", "c", None])))
        return d

    for k in range(260):
        words = prose(rng.randint(55, 160))
        if k % 4 == 0:
            words = [w + "##" if rng.random() < 0.8 else w for w in words]
        d = add(words)
        quality_of[d] = int(k % 4 != 0)
    for _ in range(15):
        words = prose(120)
        for _ in range(rng.choice([1, 3, 6])):
            copy = list(words)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            add(copy)
    for _ in range(12):
        words = prose(400)
        words.insert(rng.randrange(400), rng.choice([f"password={''.join(rng.choices(letters, k=12))}", "".join(rng.choices(letters, k=40)), "AKIA" + "".join(rng.choices(string.ascii_uppercase, k=16))]))
        add(words)
    same = prose(70)
    for _ in range(9):
        add(same, "c", 4)
    add(prose(80), "a", 4)
    add(prose(80), "a", 4)
    add(prose(60), "b", None)
    add(prose(20))
    rows.append((9001, None, "en", "a"))
    rng.shuffle(rows)
    return rows, quality_of


def test_run_against_a_brute_force_version(spark, tmp_path):
    rows, quality_of = corpus()
    documents(spark, rows, ("_q", "t1", "copies")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in quality_of.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    plain = [(d, t, s) for d, t, _, s in rows]
    rules = brute.learned_rules([(d, t) for d, t, _ in plain if d is not None], quality_of)
    assert rules
    kept = [r for r in plain if brute.good(r[1], rules)]
    assert 150 < len(kept) < len(plain) - 60
    kept = brute.first_of_near_copies(kept)
    # the models are trained on the documents that are left; what they do to a text is worked out here
    left = documents(spark, [(d, t, "en", s) for d, t, s in kept])
    model = secrets.train(secrets.random_samples(spark).unionAll(secrets.ordinary_samples(left)))
    clean = [(d, brute.masked(t, brute.all_spans(t, model.ratios, model.threshold, secrets.ALPHABET)), s) for d, t, s in kept]
    assert sum("[SECRET]" in t for _, t, _ in clean) >= 7
    copies, *_ = brute.mix(clean)
    ranks = bytebpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = Counter()
    for (d, t, _), n in zip(clean, copies, strict=True):
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        wanted[(d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)] += n
    assert found == +wanted


def test_quality_verdicts_against_a_brute_force_learner(spark):
    rows, quality_of = corpus(11)
    docs = documents(spark, rows, ("_q", "rule"))
    labels = spark.createDataFrame(list(quality_of.items()), "doc_id long, quality int")
    rules = brute.learned_rules([(d, t) for d, t, *_ in rows if d is not None], quality_of)
    wanted = Counter((d, brute.base_failed(t), brute.good(t, rules)) for d, t, *_ in rows)
    assert rules and Counter((r.doc_id, r._base_failed, r._kept) for r in quality.judge(docs, labels).collect()) == wanted


def test_mix_against_a_brute_force_version(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(int(rng.paretovariate(1.1) * 6))), "en", rng.choice(["a", "b", "c", "c", "c", None])) for k in range(500)]
    rows += [(1000, "one row again and again", "en", "c")] * 500 + [(2000, None, "en", "d"), (None, "no id here", "en", "a")]
    copies, target, size = brute.mix([(d, t, s) for d, t, _, s in rows])
    found = mixing.mix_digest(documents(spark, rows, ("size", "_u"))).collect()
    assert Counter((r.doc_id, r.size, r.taken, r.copies) for r in found) == Counter((d, brute.n_words(t), brute.n_words(t) * n, n) for (d, t, *_), n in zip(rows, copies, strict=True))
    source = {d: s for d, _, _, s in rows}
    assert all(abs(r.target - target[source[r.doc_id]]) < 1e-6 * target[source[r.doc_id]] + 1e-9 and r.source_size == size[source[r.doc_id]] for r in found)
