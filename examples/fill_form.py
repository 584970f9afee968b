"""Fill a form: replace placeholders, then put texts into cells that are blank.

    python examples/fill_form.py form.hwp out.hwp '{"{name}": "Kim"}' '{"BodyText/Section0": {"12": "filled"}}'
"""

import json
import sys

from folioframe.sources import hangul


def fill(data: bytes, values: dict[str, str], blanks: dict[str, dict]) -> bytes:
    made, _ = hangul.replace(data, list(values.items()))
    return hangul.fill_blank(made, blanks) if blanks else made


if __name__ == "__main__":
    source, target, values, *blanks = sys.argv[1:]
    with open(source, "rb") as f:
        made = fill(f.read(), json.loads(values), json.loads(blanks[0]) if blanks else {})
    with open(target, "wb") as f:
        f.write(made)
