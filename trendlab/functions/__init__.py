from trendlab.functions.arrays import bind, centred, cosine, l2_normalize, mean, norm, pearson, pearson_to
from trendlab.functions.embedding import model_embedder, ngram_embedder
from trendlab.functions.ranks import has_time, inverse_rank, is_rank, log_rank, parse_date, parse_rank, parse_time, rank_value
from trendlab.functions.text import char_count, tokens, word_count, words

__all__ = [
    "bind", "centred", "char_count", "cosine", "has_time", "inverse_rank", "is_rank", "l2_normalize", "log_rank", "mean",
    "model_embedder", "ngram_embedder", "norm", "parse_date", "parse_rank", "parse_time", "pearson", "pearson_to",
    "rank_value", "tokens", "word_count", "words",
]
