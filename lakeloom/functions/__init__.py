"""Column functions: normalisation, strict casts, keys, money and calendar. None depends on the ANSI setting."""

from lakeloom.functions.columns import *  # noqa: F403
