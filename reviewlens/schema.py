"""Fixed names and encodings shared by every module."""

from __future__ import annotations

# Aspect order of the training tables and of every label vector.
ASPECTS = ["general", "price", "quality", "service", "stylefood", "location", "background"]

# Aspect names of the annotation files, same order.
ANNOTATION_ASPECTS = [
    "GENERAL", "PRICE", "QUALITY", "SERVICE", "FOODSTYLES", "LOCATION", "BACKGROUND",
]

# Position in this list is the annotation code.
SENTIMENTS = ["dne", "negative", "neutral", "positive"]

# Training encoding: -2 absent, -1 negative, 0 neutral, 1 positive.
ABSENT = -2.0
