"""Queries of the subpackage, for the driver."""

from __future__ import annotations

from millrace.llm.op01_sharding import ORACLE as OP1_SQL
from millrace.llm.op01_sharding import op1_sharding
from millrace.llm.op02_mixing import op2_mixing
from millrace.llm.op03_decontaminate import ORACLE as OP3_SQL
from millrace.llm.op03_decontaminate import op3_decontaminate
from millrace.llm.op04_suffix_dedup import ORACLE as OP4_SQL
from millrace.llm.op04_suffix_dedup import op4_suffix_dedup
from millrace.llm.op05_line_templates import ORACLE as OP5_SQL
from millrace.llm.op05_line_templates import op5_line_templates
from millrace.llm.op06_token_counts import op6_token_rollup
from millrace.llm.op07_quality import op7_quality_rules
from millrace.llm.op08_minhash import ORACLE as OP8_SQL
from millrace.llm.op08_minhash import op8_minhash_dedup
from millrace.llm.op09_html import op9_main_text
from millrace.llm.op10_secrets import op10_secret_scan


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_mixing": op2_mixing,
        "op3_decontaminate": op3_decontaminate,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_line_templates": op5_line_templates,
        "op6_token_rollup": op6_token_rollup,
        "op7_quality_rules": op7_quality_rules,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_main_text": op9_main_text,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    """Only where SQL gives the whole result; the others are tested against plain versions in tests/llm."""
    return {"op1_sharding": OP1_SQL, "op3_decontaminate": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_line_templates": OP5_SQL, "op8_minhash_dedup": OP8_SQL}
