"""Streams: there is no streaming operator. Permutation inference needs the whole vector,
so every statistic here is a batch computation over a finished table."""
