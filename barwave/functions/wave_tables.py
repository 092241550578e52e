"""Wave grammar: fixed values."""

from __future__ import annotations

_B = ("ZIGZAG", "DOUBLE_ZIGZAG", "TRIPLE_ZIGZAG", "FLAT_EXTENDED", "FLAT_RUNNING", "FLAT_REGULAR", "TRIANGLE_CONTRACTING", "TRIANGLE_RUNNING")
_ZZ = ("ZIGZAG", "DOUBLE_ZIGZAG")
_FLAT = {"a": _ZZ, "b": _ZZ, "c": ("IMPULSE", "DIAGONAL_CONTRACTING_ENDING")}
_TRIANGLE = {k: _ZZ for k in "abcde"}

# model -> wave -> sub-models (a single leg may stand for any wave)
GRAMMAR: dict[str, dict[str, tuple[str, ...]]] = {
    "IMPULSE": {
        "1": ("IMPULSE", "DIAGONAL_CONTRACTING_INITIAL"),
        "2": ("ZIGZAG", "DOUBLE_ZIGZAG", "FLAT_EXTENDED", "FLAT_RUNNING", "FLAT_REGULAR"),
        "3": ("IMPULSE",),
        "4": ("ZIGZAG", "DOUBLE_ZIGZAG", "FLAT_EXTENDED", "FLAT_RUNNING", "FLAT_REGULAR", "TRIANGLE_CONTRACTING", "TRIANGLE_RUNNING"),
        "5": ("IMPULSE", "DIAGONAL_CONTRACTING_ENDING"),
    },
    "DIAGONAL_CONTRACTING_INITIAL": {
        "1": ("IMPULSE", "DIAGONAL_CONTRACTING_INITIAL", "ZIGZAG", "DOUBLE_ZIGZAG"),
        "2": _ZZ,
        "3": ("IMPULSE", "ZIGZAG", "DOUBLE_ZIGZAG"),
        "4": _ZZ,
        "5": ("IMPULSE", "DIAGONAL_CONTRACTING_ENDING", "ZIGZAG", "DOUBLE_ZIGZAG"),
    },
    "DIAGONAL_CONTRACTING_ENDING": {k: _ZZ for k in "12345"},
    "ZIGZAG": {"a": ("IMPULSE", "DIAGONAL_CONTRACTING_INITIAL"), "b": _B, "c": ("IMPULSE", "DIAGONAL_CONTRACTING_ENDING")},
    "DOUBLE_ZIGZAG": {"w": ("ZIGZAG",), "x": _B, "y": ("ZIGZAG",)},
    "TRIPLE_ZIGZAG": {"w": ("ZIGZAG",), "x": _B[:6], "y": ("ZIGZAG",), "xx": _B, "z": ("ZIGZAG",)},
    "FLAT_EXTENDED": _FLAT,
    "FLAT_RUNNING": _FLAT,
    "FLAT_REGULAR": _FLAT,
    "TRIANGLE_CONTRACTING": _TRIANGLE,
    "TRIANGLE_RUNNING": _TRIANGLE,
}
COEFFICIENT = {
    "IMPULSE": 1.0, "DIAGONAL_CONTRACTING_INITIAL": 0.03, "DIAGONAL_CONTRACTING_ENDING": 1.0, "ZIGZAG": 1.0, "DOUBLE_ZIGZAG": 1.0,
    "TRIPLE_ZIGZAG": 0.01, "FLAT_EXTENDED": 1.0, "FLAT_RUNNING": 1.0, "FLAT_REGULAR": 0.05, "TRIANGLE_CONTRACTING": 1.5,
    "TRIANGLE_RUNNING": 0.3, "SIMPLE_IMPULSE": 0.25,
}
START_MODELS = ("IMPULSE", "DIAGONAL_CONTRACTING_INITIAL", "ZIGZAG", "DOUBLE_ZIGZAG")

# leg ratios checked and scored: (weight map, leg, reference leg)
_DIAG = (("diagonal_correction", 2, 1), ("diagonal_3_to_1", 3, 1), ("diagonal_correction", 4, 3), ("diagonal_5_to_3", 5, 3))
_TRI = tuple(("triangle_next_to_prev", i + 1, i) for i in range(1, 5))
RATIOS: dict[str, tuple[tuple[str, int, int], ...]] = {
    "IMPULSE": (("correction", 2, 1), ("impulse_3_to_1", 3, 1), ("impulse_4_to_3", 4, 3), ("impulse_5_to_1", 5, 1)),
    "DIAGONAL_CONTRACTING_INITIAL": _DIAG,
    "DIAGONAL_CONTRACTING_ENDING": _DIAG,
    "ZIGZAG": (("correction", 2, 1), ("zigzag_c_to_a", 3, 1)),
    "DOUBLE_ZIGZAG": (("correction", 2, 1), ("zigzag_c_to_a", 3, 1)),
    "TRIPLE_ZIGZAG": (("correction", 2, 1), ("zigzag_c_to_a", 3, 1), ("correction", 4, 3), ("zigzag_z_to_w", 5, 1)),
    "FLAT_EXTENDED": (("flat_extended_b_to_a", 2, 1), ("flat_extended_c_to_a", 3, 1)),
    "FLAT_RUNNING": (("flat_running_b_to_a", 2, 1), ("flat_running_c_to_a", 3, 1)),
    "FLAT_REGULAR": (("flat_regular_b_to_a", 2, 1), ("flat_regular_c_to_a", 3, 1)),
    "TRIANGLE_CONTRACTING": _TRI,
    "TRIANGLE_RUNNING": _TRI,
}

# (parent, wave, child) -> calibrated share x slot budget
POSITION_PROBABILITY: dict[tuple[str, str, str], float] = {
    ("DIAGONAL_CONTRACTING_ENDING", "1", "SIMPLE_IMPULSE"): 1.663835,
    ("DIAGONAL_CONTRACTING_ENDING", "1", "ZIGZAG"): 0.294903,
    ("DIAGONAL_CONTRACTING_ENDING", "1", "DOUBLE_ZIGZAG"): 0.291262,
    ("DIAGONAL_CONTRACTING_ENDING", "2", "SIMPLE_IMPULSE"): 2.104369,
    ("DIAGONAL_CONTRACTING_ENDING", "2", "ZIGZAG"): 0.087379,
    ("DIAGONAL_CONTRACTING_ENDING", "2", "DOUBLE_ZIGZAG"): 0.058252,
    ("DIAGONAL_CONTRACTING_ENDING", "3", "SIMPLE_IMPULSE"): 1.714806,
    ("DIAGONAL_CONTRACTING_ENDING", "3", "ZIGZAG"): 0.298544,
    ("DIAGONAL_CONTRACTING_ENDING", "3", "DOUBLE_ZIGZAG"): 0.23665,
    ("DIAGONAL_CONTRACTING_ENDING", "4", "SIMPLE_IMPULSE"): 2.115291,
    ("DIAGONAL_CONTRACTING_ENDING", "4", "DOUBLE_ZIGZAG"): 0.083738,
    ("DIAGONAL_CONTRACTING_ENDING", "4", "ZIGZAG"): 0.050971,
    ("DIAGONAL_CONTRACTING_ENDING", "5", "SIMPLE_IMPULSE"): 2.089806,
    ("DIAGONAL_CONTRACTING_ENDING", "5", "DOUBLE_ZIGZAG"): 0.091019,
    ("DIAGONAL_CONTRACTING_ENDING", "5", "ZIGZAG"): 0.069175,
    ("DIAGONAL_CONTRACTING_INITIAL", "1", "SIMPLE_IMPULSE"): 1.841667,
    ("DIAGONAL_CONTRACTING_INITIAL", "1", "ZIGZAG"): 0.505556,
    ("DIAGONAL_CONTRACTING_INITIAL", "1", "IMPULSE"): 0.469444,
    ("DIAGONAL_CONTRACTING_INITIAL", "1", "DOUBLE_ZIGZAG"): 0.433333,
    ("DIAGONAL_CONTRACTING_INITIAL", "2", "SIMPLE_IMPULSE"): 2.1,
    ("DIAGONAL_CONTRACTING_INITIAL", "2", "ZIGZAG"): 0.1,
    ("DIAGONAL_CONTRACTING_INITIAL", "2", "DOUBLE_ZIGZAG"): 0.05,
    ("DIAGONAL_CONTRACTING_INITIAL", "3", "SIMPLE_IMPULSE"): 1.408333,
    ("DIAGONAL_CONTRACTING_INITIAL", "3", "ZIGZAG"): 1.011111,
    ("DIAGONAL_CONTRACTING_INITIAL", "3", "IMPULSE"): 0.433333,
    ("DIAGONAL_CONTRACTING_INITIAL", "3", "DOUBLE_ZIGZAG"): 0.397222,
    ("DIAGONAL_CONTRACTING_INITIAL", "4", "SIMPLE_IMPULSE"): 2.05,
    ("DIAGONAL_CONTRACTING_INITIAL", "4", "ZIGZAG"): 0.125,
    ("DIAGONAL_CONTRACTING_INITIAL", "4", "DOUBLE_ZIGZAG"): 0.075,
    ("DIAGONAL_CONTRACTING_INITIAL", "5", "SIMPLE_IMPULSE"): 2.927778,
    ("DIAGONAL_CONTRACTING_INITIAL", "5", "DOUBLE_ZIGZAG"): 0.613889,
    ("DIAGONAL_CONTRACTING_INITIAL", "5", "ZIGZAG"): 0.425,
    ("DIAGONAL_CONTRACTING_INITIAL", "5", "IMPULSE"): 0.236111,
    ("DIAGONAL_CONTRACTING_INITIAL", "5", "DIAGONAL_CONTRACTING_ENDING"): 0.047222,
    ("DOUBLE_ZIGZAG", "w", "SIMPLE_IMPULSE"): 0.825374,
    ("DOUBLE_ZIGZAG", "w", "ZIGZAG"): 0.424626,
    ("DOUBLE_ZIGZAG", "x", "SIMPLE_IMPULSE"): 3.513073,
    ("DOUBLE_ZIGZAG", "x", "FLAT_RUNNING"): 1.301063,
    ("DOUBLE_ZIGZAG", "x", "DOUBLE_ZIGZAG"): 0.336412,
    ("DOUBLE_ZIGZAG", "x", "FLAT_EXTENDED"): 0.286761,
    ("DOUBLE_ZIGZAG", "x", "ZIGZAG"): 0.277641,
    ("DOUBLE_ZIGZAG", "x", "TRIANGLE_CONTRACTING"): 0.208738,
    ("DOUBLE_ZIGZAG", "x", "TRIANGLE_RUNNING"): 0.122608,
    ("DOUBLE_ZIGZAG", "x", "FLAT_REGULAR"): 0.053704,
    ("DOUBLE_ZIGZAG", "y", "SIMPLE_IMPULSE"): 0.813953,
    ("DOUBLE_ZIGZAG", "y", "ZIGZAG"): 0.436047,
    ("FLAT_EXTENDED", "a", "SIMPLE_IMPULSE"): 2.123016,
    ("FLAT_EXTENDED", "a", "ZIGZAG"): 0.07672,
    ("FLAT_EXTENDED", "a", "DOUBLE_ZIGZAG"): 0.050265,
    ("FLAT_EXTENDED", "b", "SIMPLE_IMPULSE"): 1.533069,
    ("FLAT_EXTENDED", "b", "ZIGZAG"): 0.390212,
    ("FLAT_EXTENDED", "b", "DOUBLE_ZIGZAG"): 0.32672,
    ("FLAT_EXTENDED", "c", "SIMPLE_IMPULSE"): 1.854497,
    ("FLAT_EXTENDED", "c", "IMPULSE"): 0.236772,
    ("FLAT_EXTENDED", "c", "DIAGONAL_CONTRACTING_ENDING"): 0.15873,
    ("FLAT_REGULAR", "a", "SIMPLE_IMPULSE"): 1.588132,
    ("FLAT_REGULAR", "a", "ZIGZAG"): 0.390467,
    ("FLAT_REGULAR", "a", "DOUBLE_ZIGZAG"): 0.271401,
    ("FLAT_REGULAR", "b", "SIMPLE_IMPULSE"): 1.891051,
    ("FLAT_REGULAR", "b", "ZIGZAG"): 0.25214,
    ("FLAT_REGULAR", "b", "DOUBLE_ZIGZAG"): 0.106809,
    ("FLAT_REGULAR", "c", "SIMPLE_IMPULSE"): 2.162451,
    ("FLAT_REGULAR", "c", "IMPULSE"): 0.050778,
    ("FLAT_REGULAR", "c", "DIAGONAL_CONTRACTING_ENDING"): 0.03677,
    ("FLAT_RUNNING", "a", "SIMPLE_IMPULSE"): 1.818537,
    ("FLAT_RUNNING", "a", "DOUBLE_ZIGZAG"): 0.238327,
    ("FLAT_RUNNING", "a", "ZIGZAG"): 0.193137,
    ("FLAT_RUNNING", "b", "SIMPLE_IMPULSE"): 1.488966,
    ("FLAT_RUNNING", "b", "DOUBLE_ZIGZAG"): 0.419662,
    ("FLAT_RUNNING", "b", "ZIGZAG"): 0.341371,
    ("FLAT_RUNNING", "c", "SIMPLE_IMPULSE"): 2.150985,
    ("FLAT_RUNNING", "c", "IMPULSE"): 0.053537,
    ("FLAT_RUNNING", "c", "DIAGONAL_CONTRACTING_ENDING"): 0.045478,
    ("IMPULSE", "1", "SIMPLE_IMPULSE"): 1.208096,
    ("IMPULSE", "1", "IMPULSE"): 0.069241,
    ("IMPULSE", "1", "DIAGONAL_CONTRACTING_INITIAL"): 0.002663,
    ("IMPULSE", "2", "SIMPLE_IMPULSE"): 1.956056,
    ("IMPULSE", "2", "FLAT_RUNNING"): 1.488289,
    ("IMPULSE", "2", "FLAT_EXTENDED"): 0.310566,
    ("IMPULSE", "2", "ZIGZAG"): 0.249859,
    ("IMPULSE", "2", "DOUBLE_ZIGZAG"): 0.162312,
    ("IMPULSE", "2", "FLAT_REGULAR"): 0.132917,
    ("IMPULSE", "3", "SIMPLE_IMPULSE"): 0.930859,
    ("IMPULSE", "3", "IMPULSE"): 0.319141,
    ("IMPULSE", "4", "SIMPLE_IMPULSE"): 2.5845,
    ("IMPULSE", "4", "FLAT_RUNNING"): 1.386075,
    ("IMPULSE", "4", "FLAT_REGULAR"): 0.817685,
    ("IMPULSE", "4", "FLAT_EXTENDED"): 0.374394,
    ("IMPULSE", "4", "ZIGZAG"): 0.292807,
    ("IMPULSE", "4", "TRIANGLE_CONTRACTING"): 0.287368,
    ("IMPULSE", "4", "DOUBLE_ZIGZAG"): 0.231164,
    ("IMPULSE", "4", "TRIANGLE_RUNNING"): 0.126007,
    ("IMPULSE", "5", "SIMPLE_IMPULSE"): 2.078132,
    ("IMPULSE", "5", "IMPULSE"): 0.115025,
    ("IMPULSE", "5", "DIAGONAL_CONTRACTING_ENDING"): 0.056844,
    ("TRIANGLE_CONTRACTING", "a", "SIMPLE_IMPULSE"): 1.55042,
    ("TRIANGLE_CONTRACTING", "a", "DOUBLE_ZIGZAG"): 0.434874,
    ("TRIANGLE_CONTRACTING", "a", "ZIGZAG"): 0.264706,
    ("TRIANGLE_CONTRACTING", "b", "SIMPLE_IMPULSE"): 1.755252,
    ("TRIANGLE_CONTRACTING", "b", "DOUBLE_ZIGZAG"): 0.305672,
    ("TRIANGLE_CONTRACTING", "b", "ZIGZAG"): 0.189076,
    ("TRIANGLE_CONTRACTING", "c", "SIMPLE_IMPULSE"): 1.859244,
    ("TRIANGLE_CONTRACTING", "c", "DOUBLE_ZIGZAG"): 0.201681,
    ("TRIANGLE_CONTRACTING", "c", "ZIGZAG"): 0.189076,
    ("TRIANGLE_CONTRACTING", "d", "SIMPLE_IMPULSE"): 2.00105,
    ("TRIANGLE_CONTRACTING", "d", "DOUBLE_ZIGZAG"): 0.135504,
    ("TRIANGLE_CONTRACTING", "d", "ZIGZAG"): 0.113445,
    ("TRIANGLE_CONTRACTING", "e", "SIMPLE_IMPULSE"): 2.12395,
    ("TRIANGLE_CONTRACTING", "e", "DOUBLE_ZIGZAG"): 0.069328,
    ("TRIANGLE_CONTRACTING", "e", "ZIGZAG"): 0.056723,
    ("TRIANGLE_RUNNING", "a", "SIMPLE_IMPULSE"): 1.781394,
    ("TRIANGLE_RUNNING", "a", "DOUBLE_ZIGZAG"): 0.234303,
    ("TRIANGLE_RUNNING", "a", "ZIGZAG"): 0.234303,
    ("TRIANGLE_RUNNING", "b", "SIMPLE_IMPULSE"): 1.278331,
    ("TRIANGLE_RUNNING", "b", "DOUBLE_ZIGZAG"): 0.520291,
    ("TRIANGLE_RUNNING", "b", "ZIGZAG"): 0.451378,
    ("TRIANGLE_RUNNING", "c", "SIMPLE_IMPULSE"): 1.498851,
    ("TRIANGLE_RUNNING", "c", "DOUBLE_ZIGZAG"): 0.382466,
    ("TRIANGLE_RUNNING", "c", "ZIGZAG"): 0.368683,
    ("TRIANGLE_RUNNING", "d", "SIMPLE_IMPULSE"): 1.819296,
    ("TRIANGLE_RUNNING", "d", "ZIGZAG"): 0.223966,
    ("TRIANGLE_RUNNING", "d", "DOUBLE_ZIGZAG"): 0.206738,
    ("TRIANGLE_RUNNING", "e", "SIMPLE_IMPULSE"): 1.946784,
    ("TRIANGLE_RUNNING", "e", "DOUBLE_ZIGZAG"): 0.151608,
    ("TRIANGLE_RUNNING", "e", "ZIGZAG"): 0.151608,
    ("ZIGZAG", "a", "SIMPLE_IMPULSE"): 1.24456,
    ("ZIGZAG", "a", "IMPULSE"): 0.03475,
    ("ZIGZAG", "a", "DIAGONAL_CONTRACTING_INITIAL"): 0.00069,
    ("ZIGZAG", "b", "SIMPLE_IMPULSE"): 3.604396,
    ("ZIGZAG", "b", "FLAT_RUNNING"): 1.466873,
    ("ZIGZAG", "b", "FLAT_EXTENDED"): 0.284601,
    ("ZIGZAG", "b", "ZIGZAG"): 0.227571,
    ("ZIGZAG", "b", "TRIANGLE_RUNNING"): 0.215507,
    ("ZIGZAG", "b", "DOUBLE_ZIGZAG"): 0.129414,
    ("ZIGZAG", "b", "TRIANGLE_CONTRACTING"): 0.104738,
    ("ZIGZAG", "b", "FLAT_REGULAR"): 0.0669,
    ("ZIGZAG", "c", "SIMPLE_IMPULSE"): 2.156553,
    ("ZIGZAG", "c", "IMPULSE"): 0.063511,
    ("ZIGZAG", "c", "DIAGONAL_CONTRACTING_ENDING"): 0.029935,
}
