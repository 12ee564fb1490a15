"""Streaming forms: ratings on keyed state, and windowed event counts with a watermark.

Beyond the batch operators: the same rating steps run on a stream of matches."""
