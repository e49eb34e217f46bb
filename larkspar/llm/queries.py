"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from larkspar.llm.classifier import op5_classifier
from larkspar.llm.decontaminate import OP6_SQL, op6_decontaminate
from larkspar.llm.licenses import op1_licenses
from larkspar.llm.mixing import OP7_SQL, op7_mixing
from larkspar.llm.pii import op9_pii
from larkspar.llm.quality import OP3_SQL, op3_quality
from larkspar.llm.sharding import op4_sharding
from larkspar.llm.simhash import op2_simhash
from larkspar.llm.substring import OP10_SQL, op10_substring
from larkspar.llm.warc import OP8_SQL, op8_warc

QUERIES = {f.__name__: f for f in (op1_licenses, op2_simhash, op3_quality, op4_sharding, op5_classifier, op6_decontaminate, op7_mixing, op8_warc, op9_pii, op10_substring)}
ORACLES: dict[str, str] = {"op3_quality": OP3_SQL, "op6_decontaminate": OP6_SQL, "op7_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op10_substring": OP10_SQL}
