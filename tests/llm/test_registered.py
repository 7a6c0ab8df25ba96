"""The registered queries on a small scale, beside their SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from snapspark.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_brown_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7_chat_windows": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got and set(COLUMNS.get(name, [])) <= set(columns)
    if name in Q.ORACLES:
        duck = duckdb.connect()
        for path in Path(SF).glob("*.parquet"):
            duck.execute(f"create view {path.stem} as select * from '{path}'")
        cursor = duck.execute(Q.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
