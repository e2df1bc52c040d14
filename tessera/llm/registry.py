"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .chat import SQL as CHAT_SQL
from .chat import op9_chat_prefix_target
from .decontaminate import op7_decontamination
from .licenses import op5_license_scan
from .lines import SQL as LINES_SQL
from .lines import op1_line_dedup
from .media import op10_media_chunks
from .mixing import SQL as MIXING_SQL
from .mixing import op11_mixing
from .neardup import SQL as NEARDUP_SQL
from .neardup import op4_minhash
from .passages import op8_substring_dedup
from .pieces import op6_sentencepiece
from .repair import SQL as REPAIR_SQL
from .repair import op13_conversation_repair
from .shards import SQL as SHARDS_SQL
from .shards import op2_sharding
from .toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_toxicity, op4_minhash, op5_license_scan, op6_sentencepiece, op7_decontamination, op8_substring_dedup, op9_chat_prefix_target, op10_media_chunks, op11_mixing, op12_token_alignment, op13_conversation_repair)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINES_SQL, "op2_sharding": SHARDS_SQL, "op4_minhash": NEARDUP_SQL, "op9_chat_prefix_target": CHAT_SQL, "op11_mixing": MIXING_SQL, "op13_conversation_repair": REPAIR_SQL}
