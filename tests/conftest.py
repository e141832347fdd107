import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tracequarry.session import get_spark, shared_dir

    s = get_spark(cores="4", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    return s


SPAN_DEFAULTS = {c: None for c in ("session_id", "user_id", "account_id", "source", "span_id", "trace_id", "parent_id", "name", "span_kind", "start_time", "end_time", "status_code", "input_value", "output_value", "input_messages", "output_messages", "llm_model_name", "llm_token_count_prompt", "llm_token_count_completion", "llm_token_count_total", "backend", "raw_attributes")}


@pytest.fixture(scope="session")
def make_spans(spark):
    from tracequarry.sources.schemas import SPANS

    names = [x.split()[0] for x in SPANS.split(", ")]

    def make(*rows, **extra):
        data = [tuple([i + 1, *({**SPAN_DEFAULTS, **r}[n] for n in names)]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "id long, " + SPANS)

    return make
