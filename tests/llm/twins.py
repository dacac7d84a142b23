"""Two words of 1024 letters that a polynomial hash modulo 2**64 cannot tell apart, whatever its base and byte values."""

THUE_MORSE = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
SWAPPED = THUE_MORSE.translate(str.maketrans("ab", "ba"))
