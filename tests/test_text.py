import pytest
from pyspark.sql import functions as F

from lodeweave.functions import ids, questions, segments
from lodeweave.functions import text as tx


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "n"), [("the", 1), ("contract", 2), ("12345", 2), (",", 1), ("", 0), (None, 0), ("two words, 12", 5)])
def test_token_count(spark, text, n):
    assert one(spark, tx.token_count(F.col("t")), t=text) == n == segments.count(text)


@pytest.mark.parametrize(("word", "want"), [("policies", "policy"), ("classes", "class"), ("losses", "loss"), ("clauses", "clause"), ("basis", "basis"), ("status", "status"), ("termination", "terminate"), ("indemnity", "indemnify")])
def test_canonical_terms(spark, word, want):
    assert one(spark, tx.canonical_term(F.col("t")), t=word) == want == questions.term(word)


def test_terms_keep_clause_numbers(spark):
    assert one(spark, tx.terms(F.col("t")), t="the clause 4.2") == ["clause", "4.2"] == questions.tokenize("the clause 4.2")


@pytest.mark.parametrize(("text", "want"), [("4. TERMINATION", True), ("14.25", False), ("USD 4.20", False)])
def test_reference_containment(spark, text, want):
    assert one(spark, tx.mentions_reference(F.col("t"), "4"), t=text) is want


def test_line_repair(spark):
    assert one(spark, tx.repair_lines(F.col("t")), t="termi-\nnation") == "termination"
    assert one(spark, tx.repair_lines(F.col("t")), t="Anti-\nCorruption") == "Anti-\nCorruption"


def test_masked_fingerprint_guard(spark):
    m = tx.masked_fingerprint(F.col("t"))
    assert one(spark, m, t="Clause 3 in the Schedule applies here") == ""
    assert one(spark, m, t="Clause 3 of the Schedule applies") == "clause # of the schedule applies"
    assert one(spark, m, t="This is page 3 of the long agreement text") == "this is page # of the long agreement text"


def test_noise_and_page_numbers(spark):
    for line, noise, page in (("----", True, False), ("x", True, True), ("7", False, True), ("Page 3 of 9", False, True), ("a plain line", False, False)):
        assert one(spark, tx.is_noise(F.col("t")), t=line) is noise
        assert one(spark, tx.is_page_number(F.col("t")), t=line) is page


def test_social_cleaning(spark):
    assert one(spark, tx.clean_social(F.col("t"), ["the"]), t="YAAARRR the é! http://x.y @me #tag a") == "yaarr"


def test_section_labels(spark):
    label = tx.section_label(F.col("t"))
    assert one(spark, label, t="4. Termination") == "4. Termination"
    assert one(spark, label, t="GOVERNING LAW") == "GOVERNING LAW"
    assert one(spark, label, t="This is an ordinary sentence that ends with a stop and goes on.") is None
    assert one(spark, label, t="Page 3") is None


def test_uuid5_is_pythons(spark):
    import uuid

    assert one(spark, ids.uuid5(F.col("t")), t="añ|0|x") == uuid.uuid5(ids.NAMESPACE, "añ|0|x").hex


def test_questions():
    q = questions.prepare("Can you please tell me what is the termination notice in Sec. 4.2 and \"force majeure\"?")
    assert ("section", "4.2") in q.references and q.phrases == ["force majeure"] and "terminate" in q.terms
    assert questions.prepare("what are the").terms  # stopwords kept where nothing else is left
    assert questions.prepare(None).terms == []


def test_sentences():
    assert segments.sentences("See Art. 5 of it. Then Mr. Smith left! (He did.) ok") == ["See Art. 5 of it.", "Then Mr. Smith left!", "(He did.) ok"]
    assert segments.sentences("") == []


def test_character_shingles(spark):
    assert sorted(one(spark, tx.char_shingles(F.col("t")), t="Abc-def")) == ["abc d", "bc de", "c def"]
    assert one(spark, tx.char_shingles(F.col("t")), t="") == []
