"""The registered queries of this package, and SQL for those that SQL can express."""

from .chat import OP6_SQL, op6_chat_formatting
from .decontaminate import op9_decontamination
from .embedding_join import OP4_SQL, op4_embedding_near_dedup
from .html import op5_html_extraction
from .language import op7_language_id
from .mixing import op8_mixing
from .phrases import OP13_SQL, op13_phrase_collocations
from .quality import op2_quality
from .simhash import op10_simhash_near_dedup
from .tokens import op1_token_counts
from .toxicity import op3_toxicity
from .trie import OP11_SQL, op11_prefix_trie
from .warc import OP12_SQL, op12_warc

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_quality, op3_toxicity, op4_embedding_near_dedup, op5_html_extraction, op6_chat_formatting, op7_language_id, op8_mixing, op9_decontamination, op10_simhash_near_dedup, op11_prefix_trie, op12_warc, op13_phrase_collocations)
}
ORACLES = {"op4_embedding_near_dedup": OP4_SQL, "op6_chat_formatting": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
