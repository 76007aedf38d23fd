"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from .alignment import op13_alignment
from .chat import OP10_SQL, op10_chat
from .classifier import op11_classifier
from .exact import OP6_SQL, op6_exact
from .merkle import OP12_SQL, op12_merkle
from .mixing import OP7_SQL, op7_mixing
from .personal import op9_personal
from .pieces import op5_sentencepiece
from .quality import OP8_SQL, op8_quality
from .simhash import op1_simhash
from .substring import OP2_SQL, op2_substring
from .suffixes import op4_suffixes
from .warc import OP3_SQL, op3_warc

QUERIES = {"op1_simhash": op1_simhash, "op2_substring": op2_substring, "op3_warc": op3_warc, "op4_suffixes": op4_suffixes, "op5_sentencepiece": op5_sentencepiece, "op6_exact": op6_exact, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_personal": op9_personal, "op10_chat": op10_chat, "op11_classifier": op11_classifier, "op12_merkle": op12_merkle, "op13_alignment": op13_alignment}

SQL: dict[str, str] = {"op2_substring": OP2_SQL, "op3_warc": OP3_SQL, "op6_exact": OP6_SQL, "op7_mixing": OP7_SQL, "op8_quality": OP8_SQL, "op10_chat": OP10_SQL, "op12_merkle": OP12_SQL}
