import re

import pytest

from weir.llm import licences, queries
from weir.llm import license_scan as L


def test_markup():
    a = L.compile_template("x", "start [[maybe [[inner]] end]] mid <<any:2>> stop")
    for text, end in (("start mid stop", 3), ("start maybe end mid stop", 5), ("start maybe inner end mid a b stop", 8), ("start mid a b c stop", -1), ("start maybe mid stop", -1), ("start mid stop stop", 4)):
        assert a.longest([w.encode() for w in text.split()], 0) == end, text
    for bad in ("[[x", "x]]", "[[only optional]]", "<<a:2>> x"):
        with pytest.raises(ValueError):
            L.compile_template("x", bad)


def plain_words(template, optional):
    """The words of a template with its optional regions or without them, and a word for each replaceable one."""
    text = re.sub(r"<<\w+:\d+>>", " someone " if optional else " ", template)
    while "[[" in text:
        text = re.sub(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", r" \1 " if optional else " ", text, flags=re.S)
    return L.WORDS.findall(text.encode().lower())


@pytest.mark.parametrize("label,template", [*licences.TEXTS, *licences.bodies()])
def test_whole_texts_by_their_mandatory_wording(label, template):
    a = L.compile_template(label, template)
    least, most = plain_words(template, False), plain_words(template, True)
    assert a.longest(least, 0) == len(least) and a.longest(most, 0) == len(most)
    step = max(1, len(least) // 60)
    for k in range(0, len(least), step):
        assert a.longest([*least[:k], b"altered", *least[k + 1 :]], 0) == -1
        assert a.longest([*least[:k], *least[k + 1 :]], 0) == -1 or least[k] == least[min(k + 1, len(least) - 1)]
    n, found = L.Scanner().scan(b"Some work.\n\n" + b" ".join(most) + b"\n\nMore.")
    assert n == len(most) + 3 and (label, False, 2, 2 + len(most)) in found


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(k, label) for phrase, label in L.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


TEXTS = [
    None,
    "",
    "MIT License mit-license; Mit  LICENSE",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0. MIT licenses",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "mit \x7f license é mitélicense ÀMIT license",
    "apache " * 20000 + "license general public license " + "x " * 50000,
    "general general public license public license",
]


def test_against_brute_force(spark, tmp_path):
    data = [(k, t, "n_words", 1) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "", 0), (None, TEXTS[2], None, None)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(data, "doc_id long, text string, matches string, score int").write.parquet(f"{path}/documents.parquet")
    rows = queries.op3_license_scan(spark, path).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    want = []
    for d, t, _, _ in data:
        n, places = brute(t)
        want.append((str(d), n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x[1] for x in places}))))
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[3].split(",") == ["GPL-3.0", "GPL-notice", "gpl"]
    assert labels[4].split(",") == ["Apache-2.0", "apache"]
    assert labels[5].split(",") == ["MIT-notice", "mit"] and labels[6] == "CC-BY-NC"
    assert all(0 <= r.score <= 1 for r in rows)


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
