import hashlib

from linkweave.llm.common import words_of
from linkweave.llm.decontamination import contamination_report, item_windows, without_benchmark
from tests.llm.samples import docs, prose, rows

ITEM = prose(60, 25)
ITEMS = [(1, ITEM), (2, "Short item, here"), (3, None), (4, ""), (10, ITEM), (None, prose(61, 12)), (5, "lone"), (2, "Short item, here"), (6, "a a a a a a a a a a a a")]
CASES = [
    (1, prose(62, 30) + " " + ITEM.upper().replace(" ", "... ") + " " + prose(63, 5)), (2, " ".join(ITEM.split()[3:13])),
    (3, " ".join(ITEM.split()[3:12])), (4, "a short ITEM/here and SHORT item here lone"), (5, prose(61, 12)), (6, None), (7, ""), (8, "?!"),
    (9, "a " * 30), (9, "a " * 30), (None, ITEM), (11, prose(64, 20_000) + " lone"), (12, "éa short item hereé"),
]
NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute(data):
    out = []
    for i, text in data:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in ITEMS:
            for w in item_windows(item_text):
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k:k + len(w)]) == w:
                        hit.update(range(k, k + len(w)))
                        found |= {str(item)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_against_brute_force(spark):
    assert rows(contamination_report(docs(spark, CASES), benchmark(spark)), *NAMES) == brute(CASES)


def test_tables_in_pieces(spark):
    found = contamination_report(docs(spark, CASES), benchmark(spark), table_bytes=8000)
    assert rows(found, *NAMES) == brute(CASES)


def test_clean_rows_stay(spark):
    given = docs(spark, CASES)
    clean = sorted(r[0] for r in brute(CASES) if not r[5])
    for size in (8000, 1 << 20):
        kept = without_benchmark(given, benchmark(spark), table_bytes=size)
        assert kept.columns == given.columns and sorted(r["doc_id"] for r in kept.collect()) == clean


def test_empty_tables(spark):
    assert contamination_report(docs(spark, []), benchmark(spark)).collect() == []
    none = contamination_report(docs(spark, CASES), benchmark(spark).limit(0))
    assert not any(r["contaminated"] for r in none.collect())
