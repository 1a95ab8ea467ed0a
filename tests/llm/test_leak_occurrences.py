"""Decontamination: an item that a document holds several times."""

from labelframe.llm import decontamination

ITEM = "Later Maria buys 12 apples, then Maria sells 12 pears, so Maria keeps 12 plums and Maria eats 12 figs each day on 3 km of road."
OTHER = "Later Karim buys 45 apples, then Karim sells 45 pears, so Karim keeps 45 plums and Karim eats 45 figs each day on 8 km of road."
THIRD = "Later Paula buys 71 apples, then Paula sells 71 pears, so Paula keeps 71 plums and Paula eats 71 figs each day on 5 km of road."
MIXED = "Later Karim buys 45 apples, then Tom sells 46 pears, so Lena keeps 47 plums and Anna eats 48 figs each day on 8 km of road."


def test_each_copy_of_an_item_counts_by_itself(spark):
    recurring = " ".join(f"We wait, then N{i} sells {i} pears, so N{i} keeps {i + 7} plums at home." for i in range(60))
    texts = [f"{ITEM} {OTHER}", f"{OTHER} Some words between. {THIRD}", f"{recurring} {ITEM} {recurring}", f"{MIXED} {MIXED}", f"{recurring} {recurring}", f"{OTHER} {OTHER}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.leaks(docs, items).collect()}
    assert set(rows) == {0, 1, 2, 5}
    assert rows[2]["coverage"] == 1 and rows[2]["same_values"] > 0.85 and rows[1]["consistency"] >= 0.85
    assert [r["doc_id"] for r in decontamination.remove_leaks(docs, items).orderBy("doc_id").collect()] == [3, 4]
