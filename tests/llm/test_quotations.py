import pytest

from docweft.llm import sentences as N


@pytest.fixture(scope="module")
def model(spark):
    return N.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("parts", [
    ['"The shop opens at nine.', 'The shop closes at five.', 'Nobody works on Sunday."'],
    ['A 24" screen costs 90.', "It ships on Monday.", 'A 27" screen costs 120.', "It ships on Tuesday."],
    ['The seller said, "No refund. No swap." and left.', "Then the shop closed."],
    ["He left the shop.", '"No refund is due.', 'No swap is due."', "The seller went home."],
    ["The rules (see clause 3. It binds both.) hold for all.", "Keep the box."],
    ["The clerk asked: “Who signs? Who pays?” before closing.", "Nobody answered."],
])
def test_quotations_and_inches(model, parts):
    text = " ".join(parts)
    assert [text[a:b].strip() for a, b in zip([0, *model.ends(text)], model.ends(text))] == parts


def test_closed_spans():
    t = 'A 24" or 27" screen, "a "b" c" (d [e] f'
    assert [t[i : j + 1] for i, j in N.enclosed(t, 0, len(t))] == ['"a "', '" c"', "[e]"]
