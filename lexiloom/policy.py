"""Fixed values of the statistics battery, the controls and the searches."""

from __future__ import annotations

COMMA_IS_SEPARATOR = True
HOLDOUT_SEED, HOLDOUT_FRACTION = 408, 0.15

MATTR_WINDOW = 500
ZIPF_MIN_FREQ = 2
POSITION_BINS = 5
GALLOWS = ("k", "t", "p", "f")
SEPARATOR = "."
TOP_GLYPHS = 15

CIPHER_SEED, SHUFFLE_SEED, GIBBERISH_SEED, SELF_CITATION_SEED = 409, 410, 411, 412
SEED_WORDS, EDIT_PROBABILITY, SECOND_EDIT_PROBABILITY = 12, 0.8, 0.3

SEARCH_SEED, SEARCH_COMBOS, SEARCH_REPLICATES, SEARCH_TOP = 500, 96, 5, 3
FINAL_EVAL_SEED, CROSS_EVAL_SEED, UNREPRODUCED = 501, 502, 1.0
ROBUST = 0.5

LABEL_SHUFFLES, LABEL_RARE_PAGES, LABEL_SEED = 1000, 3, 630
NULL_REPLICATES = 5
CHAMPION_SEED, LOCAL_SEED, SHUFFLED_SEED, CAMPAIGN_SEED = 600, 610, 620, 640
LINE_BUCKETS = ((1, 1), (2, 2), (3, 4), (5, 8))
PAGE_BUCKETS = ((1, 1), (2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64))
USABLE_PAGE_PAIRS, USABLE_LINE_PAIRS = 10, 50

#: The vector of a signature: fifteen numbers, in this order.
SIGNATURE_VECTOR = (
    "h1", "h2", "zipf_slope", "zipf_r2", "length_mean", "length_sd", "mattr", "hapax_rate", "identical_share",
    "distance1_share", "mean_similarity", "first_effect", "last_effect", "end_divergence", "start_divergence",
)
