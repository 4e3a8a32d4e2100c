import random

from datebook.llm.license_scan import BASE, NOTICES, FuzzyNotices, folded, license_scan, op8_license_scan
from datebook.llm.common import alnum_words


def edited(text, k, rng):
    out = list(text)
    for _ in range(k):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("qxz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("qxz"))
    return "".join(out)


def distance_within(text, notice, k):
    """Least edits of the notice to any part of the text, by dynamic programming."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(notice):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row, best = new, min(best, new[-1])
    return best <= k


def test_fuzzy_matches_agree_with_dynamic_programming():
    rng = random.Random(8)
    notice = "licensed under the apache license"
    finder, k = FuzzyNotices({notice: "apache-2.0"}), len(notice) // 12
    for n in range(300):
        text = "".join(rng.choice("abc de ") for _ in range(30)) + edited(notice, rng.randint(0, k + 2), rng) + "".join(rng.choice("abc de ") for _ in range(30))
        found = finder.find(text)
        assert bool(found) == distance_within(text, notice, k), text
        for m in found:
            assert m.errors <= k and distance_within(text[m.start : m.end], notice, m.errors)
    assert [m.start for m in finder.find(("x" * 50 + notice.upper()) * 3)] == [50, 133, 216]


def test_rows(spark):
    texts = [None, "", "CC-BY; cc by cc by", "GNU  General Public\nLicense v3. All Rights reserved!", "Licensd under the\nApache Licence, Version 2.0", "nothing here", "é cc by", "x " * 40_000 + "all rights reserved"]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    for i, t in enumerate(texts):
        words = alnum_words(t)
        want = sorted((a, label) for p, label in BASE.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.encode().split())
        assert [(p.word, p.label) for p in rows[i].places] == want and rows[i].n_words == len(words)
    assert [(m.label, m.errors) for m in rows[4].matches] == [("apache-2.0", 2)]
    assert not rows[5].matches and not rows[0].matches
    assert license_scan(docs.limit(0)).count() == 0


def test_places_of_many_phrases_count_on():
    from datebook.llm.license_scan import places

    words = [b"x", b"a", b"a", b"a", b"b"] * 5000
    want = [(i, "aa") for i in range(len(words) - 1) if words[i : i + 2] == [b"a", b"a"]] + [(i, "ab") for i in range(len(words) - 1) if words[i : i + 2] == [b"a", b"b"]]
    assert places(words, {"a a": "aa", "a b": "ab"}) == sorted(want)
    assert places([], {"a": "x"}) == [] and places([b"a"], {"a": "x"}) == [(0, "x")]


def test_matches_that_others_hid_and_folded_runs():
    find = lambda t: [(m.label, t[m.start : m.end], m.errors) for m in FuzzyNotices(NOTICES).find(t)]
    both = "licensd under the apache license, licensed under the apache license"
    assert find(both) == [("apache-2.0", "licensd under the apache license", 1), ("apache-2.0", "licensed under the apache license", 0)]
    for joint in ("\n * ", "\n// ", "\n\n#  ", "\t", "  ", " \r\n -- ", "\n"):
        text = f"x Licensed{joint}under the{joint}Apache{joint}license y"
        assert find(text) == [("apache-2.0", text[2:-2], 0)], joint
    assert find("gnu general  public   license")[0] == ("gpl", "gnu general  public   license", 0)
    assert find("a\n*b") == [] and find("") == [] and find("\n * ") == []
    assert len(find("all rights reserved " * 3000)) == 3000


def least_distance(text, notice):
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(notice):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_labels_and_score_of_the_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "cc by", "cc by and mozilla public licens"]
    for n in range(60):
        notice = rng.choice([*NOTICES, "nothing of the kind"])
        texts.append(f"{'abc ' * rng.randint(0, 9)}{edited(notice, rng.randint(0, len(notice) // 12 + 1), rng)}{rng.choice([' ', chr(10) + ' * '])}{edited(rng.choice([*NOTICES]), 3, rng)}")
    spark.createDataFrame(list(enumerate(texts)) + [(2, "cc by")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_license_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = folded(texts[r.doc_id] or "")[0]
        near = {notice: least_distance(text, notice) for notice in NOTICES}
        fits = {n: d for n, d in near.items() if d <= len(n) // 12}
        base = set(r.base_labels.split(",")) - {""}
        assert r.labels == ",".join(sorted(base | {NOTICES[n] for n in fits})), text
        assert abs(r.score - (1.0 if base else max([0.0, *(1 - d / len(n) for n, d in fits.items())]))) < 1e-12
