"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from barframe.llm.decontaminate import op2_decontamination
from barframe.llm.html_extract import op7_html
from barframe.llm.licenses import op1_licenses
from barframe.llm.line_dedup import OP8_SQL, op8_line_dedup
from barframe.llm.ngram_join import OP3_SQL, op3_ngram_join
from barframe.llm.packing import op6_packing
from barframe.llm.pii import op5_pii
from barframe.llm.quality import op4_quality
from barframe.llm.topk import OP9_SQL, op9_top_products
from barframe.llm.warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable] = {"op1_licenses": op1_licenses, "op2_decontamination": op2_decontamination, "op3_ngram_join": op3_ngram_join, "op4_quality": op4_quality, "op5_pii": op5_pii, "op6_packing": op6_packing, "op7_html": op7_html, "op8_line_dedup": op8_line_dedup, "op9_top_products": op9_top_products, "op10_warc": op10_warc}
ORACLE_SQL: dict[str, str] = {"op3_ngram_join": OP3_SQL, "op8_line_dedup": OP8_SQL, "op9_top_products": OP9_SQL, "op10_warc": OP10_SQL}
