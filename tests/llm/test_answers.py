import pytest

import __spark_entry__ as e
from sparkloom.llm.answers import defect, defects

PROMPT = "Explain why the second annotator hides the measured ranges in both languages."


@pytest.mark.parametrize("prompt, out, kind", [
    (PROMPT, None, "empty"), (PROMPT, "<p></p>", "empty"), (PROMPT, "N/A", "empty"), (PROMPT, "…", "empty"), ("How many? Reply with a number only.", "64", None),
    (PROMPT, "> " + PROMPT, "copied"), (PROMPT, "Answer: " + PROMPT + "\n" + PROMPT, "copied"), (PROMPT, "In short, the archive reads a ledger. That is why the second annotator hides the measured ranges in both languages.", None),
    ("Repeat this sentence exactly: The clockmaker sorts the copper kettle near the old bridge.", "The clockmaker sorts the copper kettle near the old bridge.", None),
    (PROMPT, "I'm sorry, but I won't write about the archive. Let me know if I can assist with something else.", "refusal"), (PROMPT, "I'm sorry to say the file never arrived. The archive reads a ledger.", None),
    (PROMPT, "La tarea nocturna compara la tetera de cobre en cuanto se cierra el lote.", "wrong_language"), ("Translate into Spanish: The archive reads a ledger.", "El archivo lee un registro en la oficina del puerto.", None),
    (PROMPT, 'It is {"a": [1, 2', "truncated"), (PROMPT, '{"a": "The archive', "truncated"), (PROMPT, "The archive reads a ledger and then,", "truncated"),
])
def test_types(prompt, out, kind):
    assert defect(prompt, out) == kind


def test_last_word_decides(spark):
    rows = [(f"x{k}", PROMPT, "The parser splits the ledger. The archive stores the wet ledger.") for k in range(5)]
    rows += [("cut", PROMPT, "The archive stores the"), ("word", PROMPT, "The archive stores the wet led"), ("mark", PROMPT, "The archive stores the wet ledger"), ("none", PROMPT, None), ("none", PROMPT, None)]
    got = defects(spark.createDataFrame(rows, "id string, p string, o string"), "id", "p", "o").collect()
    assert sorted(map(tuple, got)) == [("cut", "truncated"), ("none", "empty"), ("word", "truncated")]


def test_p2_is_registered():
    assert "p2_found" in e.queries()
