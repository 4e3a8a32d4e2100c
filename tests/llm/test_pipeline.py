import random

import tiktoken

import corpus_pipeline
from datebook.llm.byte_bpe import load_ranks

from test_decontamination import brute as brute_hits
from test_near_copies import components
from test_quality_rules import brute as brute_measures


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    bench = [(k, " ".join(word() for _ in range(14))) for k in range(5)]
    texts = [" ".join(word() for _ in range(60)) for _ in range(500)]
    toxic = {i for i in range(500) if i % 6 == 0}
    for i in toxic:
        texts[i] += " vilest foulish vilest grubbing"
    for i in range(1, 60, 6):
        texts[i] = texts[i] + ". " + bench[i % 5][1] + ". " + texts[i + 60][:40]
    # Copies beyond two bits of any fingerprint, and one that shares 3-word shingles but too few of five.
    far = lambda t, step: " ".join(word() if k % step == step - 1 else w for k, w in enumerate(t.split()))
    texts[101], texts[103], texts[104] = far(texts[107], 58), far(texts[107], 59), far(texts[107], 4)
    texts += [texts[1], texts[7], None, "", "same words " * 50, "x" + "#### " * 30, bench[0][1] + " " + bench[1][1]]
    rows = [(i, t, "en", "s" if i % 3 else "t", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if k < 5 else {}
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{sf}/out{k}")
            out = spark.read.parquet(f"{sf}/out{k}")
        after = {r.doc_id: r for r in out.collect()}
        kept.append(set(after))
        if k == 0:
            assert set(before) - set(after) == toxic
        elif k == 1:
            for i in set(before) & set(after):
                n, _, _, _, repeats, _ = brute_measures(before[i])
                assert n >= 20 and 100 * repeats <= 30 * n
            assert set(before) - set(after) == {502, 503, 504, 505}
        elif k == 2:
            groups = components(sorted(before.items()), bits=2)
            assert set(after) == {i for i, g in groups.items() if i == g}
        elif k == 3:
            for i, t in before.items():
                hit = brute_hits(t, bench)[1]
                assert hit or after[i].text == t
                assert not hit or i == 506 and i not in after or not brute_hits(after[i].text, bench)[1] and after[i].n_chars == len(after[i].text)
        else:
            encoding = tiktoken.Encoding("own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=load_ranks(corpus_pipeline.RANKS), special_tokens={})
            assert {i: r.ids for i, r in after.items()} == {i: encoding.encode_ordinary(t or "") for i, t in before.items()}
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept[-1]
