"""Every line of a file is read, skipped or rejected with a reason."""

from collections import Counter

from ladle.sources import files as S


def test_nquads(spark, tmp_path):
    good = ["<http://a> <http://b> <http://c> <http://g> .", '_:x <http://b> "v"@en .', '<http://a> <http://b> "say \\"so\\"" <http://g> .']
    bad = {"<http://a <http://b> .": "predicate", "a <http://b> <http://c> .": "subject", "<http://a> b <http://c> .": "predicate", '<http://a> <http://b> "open .': "object", "<http://a> <http://b> <http://c> <http://g>": "no full stop", "<http://a> <http://b> <http://c> g g .": "graph"}
    (tmp_path / "x.nq").write_text("\n".join([*good, "", "  ", "# note", *bad]) + "\n")
    path = str(tmp_path / "x.nq")
    assert S.read_nquads(spark, path).count() == len(good)
    found = S.rejected_nquads(spark, path).collect()
    assert {r.line: r.reason for r in found} == bad and all(r.file.endswith("x.nq") for r in found)


def test_gold(spark, tmp_path):
    (tmp_path / "a.list").write_text("1 1 1 Heat VB Ac x\n# no\n\n1 2 short\n1 x 3 oil NN F y\n1 1 2 a b c d e\n")
    path = str(tmp_path / "a.list")
    assert [r.sentence for r in S.read_gold_tokens(spark, path).orderBy("word_no").collect()] == [1, None]
    assert Counter(r.reason for r in S.rejected_gold_tokens(spark, path).collect()) == {"3 fields, not 7": 1, "no number: sentence": 1, "8 fields, not 7": 1}
    (tmp_path / "a.flow").write_bytes("1 1 1 t 1 1 2\n1 1 1 é 1 1 z\n1\n".encode("latin-1"))
    path = str(tmp_path / "a.flow")
    assert S.read_gold_edges(spark, path).count() == 2
    assert {r.line: r.reason for r in S.rejected_gold_edges(spark, path).collect()} == {"1 1 1 é 1 1 z": "no number: to_word", "1": "1 fields, not 7"}
