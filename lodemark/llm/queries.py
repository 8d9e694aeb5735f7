"""Registry of the subpackage: query name -> function of (spark, sf_dir), and DuckDB SQL where there is one."""

from .bpe import op10_byte_bpe
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_text import op13_html_extraction
from .langid import op1_language_id
from .packing import op7_packing
from .quality import op4_quality
from .search import OP11_SQL, op11_ranked_search
from .secrets import op6_secret_scan
from .simhash import op2_simhash_near_dedup
from .sketch import op9_document_fingerprints
from .substring_dedup import op5_substring_dedup
from .toxicity import op3_toxicity
from .whitening import op12_embedding_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_html_extraction": op13_html_extraction,
}

ORACLE_SQL = {"op8_exact_dedup": OP8_SQL, "op11_ranked_search": OP11_SQL}
