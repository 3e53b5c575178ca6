"""Feature catalog: named, fixed-width projections of a feature document.

The reference infers its feature columns from whatever keys the documents
happen to hold.  Here every extractor declares its output names up front, a
preset is an ordered list of extractors, and a preset compiles into ONE
``select`` producing ``features array<double>`` whose positions are given by
``FeatureSet.names``.  Catalyst then evaluates only the leaves the preset
reads; the document is parsed once per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import json_leaf as J

Builder = Callable[[Column], list[Column]]


@dataclass(frozen=True)
class Extractor:
    key: str
    names: tuple[str, ...]
    build: Builder = field(compare=False)
    # the same features as whole arrays, each leaf read once for all its elements
    arrays: Builder | None = field(compare=False, default=None)
    # array leaves and their declared widths: (path, reader, elements)
    widths: tuple[tuple[str, str, int], ...] = ()


def _fixed(arr: Column, n: int) -> list[Column]:
    return [F.get(arr, i) for i in range(n)]


def _padded(arr: Column, n: int) -> Column:
    """The first ``n`` elements, missing ones null; never null itself."""
    none = F.array_repeat(F.lit(None).cast("double"), n)
    return F.slice(F.concat(F.coalesce(arr, F.array().cast("array<double>")), none), 1, n)


def _diagonal(m: Column) -> Column:
    return F.transform(m, lambda row, i: F.sqrt(F.get(row, i)))


def mean_cov(key: str, path: str, prefix: str, n: int) -> Extractor:
    """P7+P10: mean vector and std from the covariance diagonal."""
    names = tuple(f"{prefix}_mean_{i}" for i in range(n)) + tuple(f"{prefix}_std_{i}" for i in range(n))
    return Extractor(key, names, lambda d: _fixed(J.array_leaf(d, path + ".mean"), n)
                     + [F.sqrt(F.get(F.get(J.matrix_leaf(d, path + ".cov"), i), i)) for i in range(n)],
                     lambda d: [_padded(J.array_leaf(d, path + ".mean"), n),
                                _padded(_diagonal(J.matrix_leaf(d, path + ".cov")), n)],
                     ((path + ".mean", "array", n), (path + ".cov", "matrix", n)))


def mean_var(key: str, path: str, prefix: str, n: int) -> Extractor:
    """P7+P9: mean vector and std from the variance vector."""
    names = tuple(f"{prefix}_mean_{i}" for i in range(n)) + tuple(f"{prefix}_std_{i}" for i in range(n))
    return Extractor(key, names, lambda d: _fixed(J.array_leaf(d, path + ".mean"), n)
                     + [F.sqrt(c) for c in _fixed(J.array_leaf(d, path + ".var"), n)],
                     lambda d: [_padded(J.array_leaf(d, path + ".mean"), n),
                                _padded(F.transform(J.array_leaf(d, path + ".var"), F.sqrt), n)],
                     ((path + ".mean", "array", n), (path + ".var", "array", n)))


def mean_array(key: str, path: str, prefix: str, n: int) -> Extractor:
    names = tuple(f"{prefix}_{i}" for i in range(n))
    return Extractor(key, names, lambda d: _fixed(J.array_leaf(d, path), n), lambda d: [_padded(J.array_leaf(d, path), n)],
                     ((path, "array", n),))


def scalars(key: str, pairs: list[tuple[str, str]], reader=J.scalar) -> Extractor:
    """One column per (output name, leaf path)."""
    names = tuple(n for n, _ in pairs)
    return Extractor(key, names, lambda d: [reader(d, p) for _, p in pairs])


def stats(key: str, pairs: list[tuple[str, str]], which=("mean", "var")) -> Extractor:
    """``<name>_<stat>`` for each stat object."""
    names = tuple(f"{n}_{s}" for n, _ in pairs for s in which)
    return Extractor(key, names, lambda d: [J.stat(d, p, s) for _, p in pairs for s in which])


def picked(key: str, path: str, prefix: str, idx: list[int]) -> Extractor:
    """Selected elements of an array leaf, named by their source index."""
    names = tuple(f"{prefix}_{i}" for i in idx)
    return Extractor(key, names, lambda d: [F.get(J.array_leaf(d, path), i) for i in idx], lambda d: [
        F.transform(F.array(J.array_leaf(d, path)), lambda a: F.array(*[F.get(a, i) for i in idx]))[0]])


def tonality(key: str) -> Extractor:
    names = ("key_vector_x", "key_vector_y", "key_vector_z")
    return Extractor(key, names, lambda d: J.key_vector(
        J.leaf(d, "tonal.key_key", "string"),
        J.leaf(d, "tonal.key_scale", "string"),
        J.scalar(d, "tonal.key_strength")))


def beat_loudness_std(key: str) -> Extractor:
    return Extractor(key, ("beat_loudness_mean", "beat_loudness_std"), lambda d: [
        J.stat(d, "rhythm.beats_loudness", "mean"),
        F.sqrt(J.stat(d, "rhythm.beats_loudness", "var"))])


# ---------------------------------------------------------------------------
# Document leaf paths, output names and array widths of the
# extractors (they define which numbers land in which feature column).
LL, RH, TO = "lowlevel", "rhythm", "tonal"
SHAPE_STATS = ["rolloff", "flux", "spread", "skewness", "kurtosis", "decrease", "entropy"]
BAND_STATS = ["crest", "flatness_db", "kurtosis", "skewness", "spread"]
GFCC_PICK = [0, 1, 3, 5, 7, 11]
VALLEY_PICK = [0, 3, 4, 5]

FB = {
    "mfcc": mean_cov("FB1", f"{LL}.mfcc", "mfcc", 13),
    "mel": mean_var("FB2", f"{LL}.melbands", "mel", 40),
    "centroid": scalars("FB3", [("spec_centroid_mean_0", f"{LL}.spectral_centroid.mean")]),
    "energy": scalars("FB4", [(f"spec_energy_{i}", f"{LL}.spectral_energyband_{b}.mean")
                              for i, b in enumerate(["high", "low", "middle_high", "middle_low"])]),
    "contrast": mean_array("FB5", f"{LL}.spectral_contrast_coeffs.mean", "spec_contrast_mean", 6),
    "valley": mean_array("FB6", f"{LL}.spectral_contrast_valleys.mean", "spec_valley_mean", 6),
    "hpcp": mean_array("FB7", f"{TO}.hpcp.mean", "hpcp_mean", 36),
    "tempo": scalars("FB8", [("tempo_bpm", f"{RH}.bpm")]),
    "barkbands": scalars("FB9", [("barkbands_skewness", f"{LL}.barkbands_skewness.mean"),
                                 ("barkbands_kurtosis", f"{LL}.barkbands_kurtosis.mean")]),
    "tonality": tonality("FB10"),
    "onset": scalars("FB11", [("onset_rate", f"{RH}.onset_rate")]),
    "beat_loudness": beat_loudness_std("FB12"),
}

FC = {
    "bpm": Extractor("FC5", ("bpm", "danceability", "beats_count", "bpm_hist_first_peak_bpm",
                             "bpm_hist_first_peak_weight", "bpm_hist_second_peak_bpm",
                             "bpm_hist_second_peak_weight"),
                     lambda d: [J.scalar_or_first(d, f"{RH}.bpm"),
                                J.scalar_or_first(d, f"{RH}.danceability"),
                                J.scalar_or_first(d, f"{RH}.beats_count")]
                     + [J.peak_value(d, f"{RH}.bpm_histogram_{o}_peak_{w}")
                        for o in ("first", "second") for w in ("bpm", "weight")]),
    "shape": stats("FC6", [(f"spec_{s}", f"{LL}.spectral_{s}") for s in SHAPE_STATS]),
    "loudness": Extractor("FC7", ("avg_loudness", "dynamic_complexity", "spec_rms_mean",
                                  "spec_rms_var", "zerocrossingrate_mean"),
                          lambda d: [J.scalar_or_first(d, f"{LL}.average_loudness"),
                                     J.scalar_or_first(d, f"{LL}.dynamic_complexity"),
                                     J.stat(d, f"{LL}.spectral_rms", "mean"),
                                     J.stat(d, f"{LL}.spectral_rms", "var"),
                                     J.stat(d, f"{LL}.zerocrossingrate", "mean")]),
    "pitch": stats("FC8", [(s, f"{LL}.{s}") for s in ("pitch_salience", "dissonance", "hfc")]),
    "chords": Extractor("FC9", ("chords_changes_rate", "chords_strength_mean", "chords_strength_var"),
                        lambda d: [J.scalar_or_first(d, f"{TO}.chords_changes_rate"),
                                   J.stat(d, f"{TO}.chords_strength", "mean"),
                                   J.stat(d, f"{TO}.chords_strength", "var")]),
    "hpcp_entropy": stats("FC10", [("hpcp_entropy", f"{TO}.hpcp_entropy")]),
    "silence": scalars("FC11", [(f"silence_rate_{db}dB", f"{LL}.silence_rate_{db}dB.mean")
                                for db in (20, 30, 60)]),
    "complexity": stats("FC12", [("spec_complexity", f"{LL}.spectral_complexity")]),
    "strongpeak": stats("FC13", [("spec_strongpeak", f"{LL}.spectral_strongpeak")]),
    "beats_loudness": stats("FC14", [("beat_loudness", f"{RH}.beats_loudness")]),
    "onset": scalars("FC15", [("onset_rate", f"{RH}.onset_rate")], reader=J.scalar_or_first),
    "thpcp": mean_array("FC16", f"{TO}.thpcp.mean", "thpcp_mean", 36),
    "chords_number": scalars("FC17", [("chords_number_rate", f"{TO}.chords_number_rate")],
                             reader=J.scalar_or_first),
    "barkbands": stats("FC18", [(f"barkbands_{s}", f"{LL}.barkbands_{s}") for s in BAND_STATS]),
    "erbbands": stats("FC19", [(f"erbbands_{s}", f"{LL}.erbbands_{s}") for s in BAND_STATS]),
    "melbands": stats("FC20", [(f"melbands_{s}", f"{LL}.melbands_{s}") for s in BAND_STATS]),
    "tuning": scalars("FC21", [(s, f"{TO}.{s}") for s in ("tuning_frequency", "tuning_diatonic_strength",
                                                          "tuning_equal_tempered_deviation")],
                      reader=J.scalar_or_first),
    "gfcc": mean_cov("FC22", f"{LL}.gfcc", "gfcc", 13),
}

FN = [
    picked("FN1", f"{LL}.gfcc.mean", "gfcc_mean", GFCC_PICK),
    picked("FN2", f"{LL}.spectral_contrast_valleys.mean", "spec_valley_mean", VALLEY_PICK),
    scalars("FN3-FN18", [
        ("spec_flux_mean", f"{LL}.spectral_flux.mean"),
        ("spec_spread_mean", f"{LL}.spectral_spread.mean"),
        ("spec_skewness_mean", f"{LL}.spectral_skewness.mean"),
        ("spec_kurtosis_mean", f"{LL}.spectral_kurtosis.mean"),
        ("spec_rms_mean", f"{LL}.spectral_rms.mean"),
        ("erb_spread_mean", f"{LL}.erbbands_spread.mean"),
        ("erb_flatness_mean", f"{LL}.erbbands_flatness_db.mean"),
        ("erb_crest_mean", f"{LL}.erbbands_crest.mean"),
        ("dissonance_mean", f"{LL}.dissonance.mean"),
        ("hpcp_entropy_mean", f"{TO}.hpcp_entropy.mean"),
        ("avg_loudness", f"{LL}.average_loudness"),
        ("danceability", f"{RH}.danceability"),
        ("spec_centroid_mean", f"{LL}.spectral_centroid.mean"),
        ("spec_comp_var", f"{LL}.spectral_complexity.var"),
        ("spec_entropy_mean", f"{LL}.spectral_entropy.mean"),
        ("tuning", f"{TO}.tuning_equal_tempered_deviation"),
    ]),
]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSet:
    name: str
    extractors: tuple[Extractor, ...]

    @property
    def names(self) -> list[str]:
        seen: list[str] = []
        for e in self.extractors:
            seen.extend(n for n in e.names if n not in seen)
        return seen

    @property
    def width(self) -> int:
        return len(self.names)

    def leaves(self) -> dict[str, tuple[str, str]]:
        """The leaves that the set reads: column of a shredded table -> (path, type)."""
        wanted = J.Wanted()
        self.columns(wanted)
        self.vector(wanted)
        return wanted.leaves

    def columns(self, doc: Column) -> list[Column]:
        """One double column per feature name; later duplicates are dropped."""
        out, seen = [], set()
        for e in self.extractors:
            for n, c in zip(e.names, e.build(doc)):
                if n not in seen:
                    seen.add(n)
                    out.append(c.cast("double"))
        return out

    def extra_elements(self, doc: Column) -> dict[str, Column]:
        """For each array leaf how many elements of the document lie beyond its declared width."""
        out = {}
        for e in self.extractors:
            for path, reader, n in e.widths:
                value = J.matrix_leaf(doc, path) if reader == "matrix" else J.array_leaf(doc, path)
                out[path] = F.greatest(F.coalesce(F.size(value), F.lit(0)) - n, F.lit(0))
        return out

    def vector(self, doc: Column, digits: int | None = None) -> Column:
        """All features as one array; ``digits`` rounds them.

        Array leaves come in whole (each read once, not once per element, which also
        keeps the generated code small); scalar leaves one by one, code-generated."""
        parts, single, seen = [], [], set()

        def flush():
            if single:
                parts.append(F.array(*[c if digits is None else F.round(c, digits) for c in single]))
                single.clear()
        for e in self.extractors:
            fresh = [n for n in e.names if n not in seen]
            if e.arrays and len(fresh) == len(e.names):
                flush()
                for c in e.arrays(doc):
                    parts.append(c if digits is None else F.transform(c, lambda x: F.round(x, digits)))
            else:
                single.extend(c.cast("double") for n, c in zip(e.names, e.build(doc)) if n in fresh)
            seen.update(e.names)
        flush()
        return F.concat(*parts)


def base_set(use_mel_alt=False, use_energy_alt=False, add_valley=False, add_timbre_dist=False,
             add_tonality=False, add_rhythm_struct=False) -> FeatureSet:
    """The base feature set and its options (width 70 by default)."""
    ex = [FB["mel"] if use_mel_alt else FB["mfcc"],
          FB["energy"] if use_energy_alt else FB["centroid"],
          FB["contrast"]]
    if add_valley:
        ex.append(FB["valley"])
    ex += [FB["hpcp"], FB["tempo"]]
    if add_timbre_dist:
        ex.append(FB["barkbands"])
    if add_tonality:
        ex.append(FB["tonality"])
    if add_rhythm_struct:
        ex += [FB["onset"], FB["beat_loudness"]]
    return FeatureSet("base", tuple(ex))


def comprehensive_set(use_mel_alt=False, use_energy_alt=False, extract_all=True) -> FeatureSet:
    """Core features plus 18 extra groups."""
    ex = [FB["mel"] if use_mel_alt else FB["mfcc"],
          FB["energy"] if use_energy_alt else FB["centroid"],
          FB["contrast"], FB["valley"], FB["hpcp"], FB["tonality"]]
    if extract_all:
        ex += [FC[k] for k in ("bpm", "shape", "loudness", "pitch", "chords", "hpcp_entropy",
                               "silence", "complexity", "strongpeak", "beats_loudness", "onset",
                               "thpcp", "chords_number", "barkbands", "erbbands", "melbands",
                               "tuning", "gfcc")]
    return FeatureSet("comprehensive", tuple(ex))


def selected_set() -> FeatureSet:
    """The 26 selected features of the two-category program."""
    return FeatureSet("selected", tuple(FN))


def all_alternatives_set() -> FeatureSet:
    """Base with every option, then the mel and energy alternatives."""
    full = base_set(add_valley=True, add_timbre_dist=True, add_tonality=True, add_rhythm_struct=True)
    return FeatureSet("all", full.extractors + (FB["mel"], FB["energy"]))


PRESETS = {
    "base": base_set,
    "full_run": lambda: base_set(add_valley=True, add_timbre_dist=True, add_tonality=True,
                                 add_rhythm_struct=True),
    "comprehensive": comprehensive_set,
    "selected": selected_set,
    "all": all_alternatives_set,
}


def preset(name: str) -> FeatureSet:
    return PRESETS[name]()


# The non-feature columns of a wide feature table.
EXCLUDE_COLS = ["track_id", "path", "genre", "mood", "instrument", "json_full"]


def all_leaves() -> dict[str, tuple[str, str]]:
    """The leaves of all feature sets with all their options."""
    sets = [preset(n) for n in PRESETS] + [base_set(True, True, True, True, True, True), comprehensive_set(True, True)]
    return {name: own for fs in sets for name, own in fs.leaves().items()}


def feature_columns(columns: list[str], exclude: list[str] = EXCLUDE_COLS) -> list[str]:
    """Feature columns of a wide table are all columns not in the exclusion list."""
    return [c for c in columns if c not in exclude]


def pack_wide(df, exclude: list[str] = EXCLUDE_COLS, out: str = "features"):
    """Wide feature table (e.g. read back from CSV) -> ``features array<double>`` + names."""
    names = feature_columns(df.columns, exclude)
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias(out)), names
