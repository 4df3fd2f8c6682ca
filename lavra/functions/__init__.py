from lavra.functions.text import plain_key, strip_accents, text_concept
from lavra.functions.time import micros, millis, seconds_between

__all__ = ["micros", "millis", "plain_key", "seconds_between", "strip_accents", "text_concept"]
