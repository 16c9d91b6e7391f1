"""The operators' queries over whole tables, and SQL for those that SQL can express.

SQL cannot express trained models, tokenizers, or the parsing of HTML; near-dedup by SQL would compare
too many pairs. Those queries are tested by brute force, exact round trips or held-out accuracy.
"""

from . import oracles
from .bpe import op8_byte_bpe
from .collocations import ORACLE as COLLOCATIONS
from .collocations import op11_collocations
from .exact_dedup import op3_exact_dedup
from .html_text import op7_html_text
from .language_id import op13_language_id
from .licenses import op2_license_scan
from .minhash import op5_minhash_dedup
from .mixing import ORACLE as MIXING
from .mixing import op4_mixing
from .pii import op6_pii_scan
from .quality_classifier import op9_quality_classifier
from .quality_rules import op10_quality_rules
from .secrets import op1_secret_scan
from .spelling import ORACLE as SPELLING
from .spelling import op12_spelling_variants

QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_license_scan, op3_exact_dedup, op4_mixing, op5_minhash_dedup, op6_pii_scan, op7_html_text, op8_byte_bpe, op9_quality_classifier, op10_quality_rules, op11_collocations, op12_spelling_variants, op13_language_id)
}
ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.LICENSE_SCAN,
    "op3_exact_dedup": oracles.EXACT_DEDUP,
    "op4_mixing": MIXING,
    "op10_quality_rules": oracles.QUALITY_RULES,
    "op11_collocations": COLLOCATIONS,
    "op12_spelling_variants": SPELLING,
}
