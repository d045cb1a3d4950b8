"""Invented words."""

import random


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(n)]
