from gatewell.functions.columns import (  # noqa: F401
    elapsed_micros, hours_between, literal, money, quoted, share, text_number,
)
