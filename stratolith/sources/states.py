"""State codes."""

from __future__ import annotations

#: FIPS codes and state abbreviations as the workflow's configuration has them; results must equal it,
#: so 19 and 26 are missing, and 03 and 60 are both "as".
FIPS = {
    "01": "al", "02": "ak", "03": "as", "04": "az", "05": "ar", "06": "ca", "08": "co", "09": "ct", "10": "de", "11": "dc",
    "12": "fl", "13": "ga", "15": "hi", "16": "id", "17": "il", "18": "in", "20": "ks", "21": "ky", "22": "la", "23": "me",
    "24": "md", "25": "ma", "27": "mn", "28": "ms", "29": "mo", "30": "mt", "31": "ne", "32": "nv", "33": "nh", "34": "nj",
    "35": "nm", "36": "ny", "37": "nc", "38": "nd", "39": "oh", "40": "ok", "41": "or", "42": "pa", "44": "ri", "45": "sc",
    "46": "sd", "47": "tn", "48": "tx", "49": "ut", "50": "vt", "51": "va", "53": "wa", "54": "wv", "55": "wi", "56": "wy",
    "60": "as", "64": "fm", "66": "gu", "68": "mh", "69": "mp", "70": "pw", "72": "pr", "78": "vi",
}
