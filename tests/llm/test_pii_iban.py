import pytest

from verbaloom.llm import op10_pii

IBANS = ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", "NO93 8601 1117 947"]


@pytest.mark.parametrize("behind", ["", " BIC", " BIC CAIXESBB", " EUR 120", " 2024", " DE89 3704 0044 0532 0130 00", " word"])
def test_iban_before_an_upper_case_word(spark, behind):
    texts = spark.createDataFrame([(k, f"konto {i}{behind}") for k, i in enumerate(IBANS)], "doc_id int, text string")
    got = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] == "iban"] for r in op10_pii.with_spans(texts).collect()}
    second = [behind.strip()] if behind.startswith(" DE") else []
    assert got == {k: [i, *second] for k, i in enumerate(IBANS)}


def test_iban_that_is_touched_or_wrong_is_none(spark):
    texts = spark.createDataFrame([(t,) for t in ("ES9121000418450200051332BIC", "xES9121000418450200051332", "ES91 2100 0418 4502 0005 1333 BIC")], "text string")
    assert all(s["kind"] != "iban" for r in op10_pii.with_spans(texts).collect() for s in r["pii"])
