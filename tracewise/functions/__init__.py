from tracewise.functions.text import (content_tokens, faithfulness_overlap, relevance_keyword,
                                      is_fallback_answer, validate_query, payload_summary,
                                      py_strip, EVAL_STOPWORDS)
from tracewise.functions.numeric import py_round_ratio
from tracewise.functions.timefns import floor_to_window, add_minutes
from tracewise.functions.hashing import md5_bucket
