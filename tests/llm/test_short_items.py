"""Short benchmark answers drop no clean documents in the pipeline's stage."""

from __future__ import annotations

from corpus_pipeline import decontamination
from pvgrid.llm.decontaminate import drop_contaminated

from .cases import frame

PASSAGE = "which of the ten old rivers of the land runs north"
ROWS = [(1, f"Some text. {PASSAGE.title()}, it said.", "en", "s", 1), (2, "Yes, they came in 1984.", "en", "s", 1),
        (3, "who wrote the first long book of all, then? Anna Ode wrote it", "en", "s", 1), (4, "Anna Ode came", "en", "s", 1), (5, None, "en", "s", 1)]


def test_stage_keeps_documents_with_short_answers(spark, tmp_path):
    items = [(1, PASSAGE), (2, "Yes"), (3, "1984"), (4, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.doc_id for r in decontamination(spark, frame(spark, ROWS), str(tmp_path)).collect()) == [2, 3, 4, 5]


def test_question_and_answer_together(spark):
    items = spark.createDataFrame([(1, "Who wrote the first long book of all?", "then Anna Ode")], "item_id long, question string, answer string")
    for max_chars in (8_000_000, 20):
        kept = drop_contaminated(frame(spark, ROWS), items, text_cols=("question", "answer"), max_chars=max_chars, short_items=False)
        assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
