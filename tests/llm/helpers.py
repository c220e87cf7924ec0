"""Small fixtures for the tests of the llm operators."""

from __future__ import annotations

#: null, empty, white space, special strings, accents, rare spaces, marks.
AWKWARD = [
    None, "", " ", "\n\n", "a", "don't stop", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>z", "ABC Déjà İstanbul ΣΑΣ",
    "é Å ½ ²x٠   　 \x1c\x85 end", "日本語 テスト 🙂🙂", "!!!??? ...", "a" * 5000, "ab " * 3000,
    "  lead and trail  ", "tab\tand\r\nline", "x" * 70 + " " + "x" * 70, "12345 67 8", "_under_score_", "l'élève d'Œuvre ſ",
    "the the the", "the the the",
]


def docs_of(spark, texts, **extra):
    rows = [(i, t, "src", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, ids string")
