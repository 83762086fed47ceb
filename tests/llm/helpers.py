"""Documents with everything that must not break an operator, and plain versions of what operators do."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th er on an ing tion re and the at en or ti ed es ea ha in ou st".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """Null, empty, blank, short, long and repeated texts, near copies, Unicode, rows that share an id, a row without one."""
    a, b = prose(1, 300), prose(2, 200)
    words = a.split(" ")
    near = " ".join([*words[:150], "changed", *words[151:]])
    texts = [None, "", " ", "a", "one two", a, a, near, b, a.upper(), "été à l’école 日本 😀 ½ ²", "x" * 400, "ab " * 200, "\n\n  \t\r\n" + b[:500] + "\n \n", prose(3, 30_000), "<|endoftext|> a<|endoftext|>b", "tail  ", "  head", a[:700] + " " + b[:600], "A +1 (743) 555-3824 b@c.de 1.2.3.4 4111 1111 1111 1111."]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s0", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (5, a, "en", "s1", len(a)), (7, "other text of the same id " + b[100:900], "fr", None, None), (40, None, None, None, None), (41, b, "en", "s0", 7)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
