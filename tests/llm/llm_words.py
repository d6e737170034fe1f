import re

#: Words as the operators take them.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
