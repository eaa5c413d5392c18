import hashlib
import random
import re

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, chunk string, kept int, _s_email string, bucket string"
SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def some_docs(n=60):
    """Real documents, near copies and odd rows, with columns whose names the operators use inside."""
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:n]
    rng = random.Random(3)
    passage = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(99)) for _ in range(120))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table]
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \t\n ", "fr"), (1003, "one", "en"), (1004, "x" * 30_000, "en"), (1005, "ab " * 5_000, "de")]
    rows += [(1006, table[3]["text"], "en"), (1006, table[3]["text"], "en"), (None, table[5]["text"], "en"), (None, None, None)]
    rows += [(1007, f"start {passage} end", "en"), (1008, f"other words {passage}", "en"), (1009, passage + passage, "en"), (1010, "😀 <|endoftext|> é ß  \n\n x\ty\r\n", "fr"), (1011, "中文 text, here.", "es")]
    rows += [(1012, "mail a.b+c@ex-am.co.uk, +1 (555) 123-4567, ip 10.0.0.255 and 256.1.1.1, card 4111 1111 1111 1111. password=0f0e0d0c0b0a09080706", "en")]
    return [(*r, "s", len(r[1] or ""), 1, "c", 2, "e", "b") for r in rows]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
