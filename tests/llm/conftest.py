import random

import pytest

ODD_TEXTS = [None, "", " ", "\n\t", "word", "Same Same same", "é" * 150, "ab " * 4000, "x" * 30000, "a b c d e f g h i j k l m n o"]


@pytest.fixture(scope="session")
def texts():
    """Texts with shared passages, copies, nulls, empty and long ones."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    passage = [draw.choice(words) for _ in range(120)]
    out = list(ODD_TEXTS)
    for _ in range(60):
        body = [draw.choice(words) for _ in range(draw.randint(0, 90))]
        if draw.random() < 0.5:
            a = draw.randint(0, 80)
            body[len(body) // 2 : len(body) // 2] = passage[a : a + draw.randint(5, 40)]
        out.append(draw.choice([" ", "  ", "\n"]).join(body))
    return out + out[15:20] + [out[20] + " more"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with unordered ids, a missing id, repeated rows, a null source and columns whose names clash with results."""
    rows = [((k * 37) % 997, t, "en", f"s{k % 4}" if k % 7 else None, len(t or ""), "x") for k, t in enumerate(texts)]
    rows += [(None, texts[12], "en", "s1", 3, "x"), rows[14], rows[14]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
