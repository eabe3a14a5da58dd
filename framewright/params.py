"""Driver-side parameters, computed once in single precision."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

f32 = np.float32


@dataclass(frozen=True)
class Calibration:
    global_scale: int
    quant_dc: int
    raw_quant: int
    scale: float
    inverse_scale: float

    @property
    def uniform(self) -> float:
        """Strength of the uniform field."""
        return self.raw_quant * self.scale

    @property
    def dc_scale(self) -> float:
        return self.scale * self.quant_dc


def calibrate(distance: float) -> Calibration:
    """Quantiser state for a target distance."""
    if not (np.isfinite(distance) and distance > 0):
        raise ValueError("distance must be finite and positive")
    d = f32(distance)
    ac = f32(0.725) / d
    target = max(f32(0.5) * d, min(d, f32(0.3) * f32(np.power(f32(1) / f32(0.3) * d, f32(0.83)))))
    dc = min(f32(1.095924047623553) / target, f32(50))
    wanted = int(np.clip(f32(65536) * ac / f32(5), f32(1), f32(32768)))
    global_scale = min(wanted, max(1, int(dc * f32(4096) * f32(1.6))))
    inverse = f32(65536) / f32(global_scale)
    quant_dc = int(min(f32(65536), dc * inverse + f32(0.5)))
    raw = int(np.clip(np.floor(ac * inverse + f32(0.5)), 1, 256))
    return Calibration(global_scale, quant_dc, raw, float(f32(global_scale) / f32(65536)), float(inverse))


@dataclass(frozen=True)
class FieldParams:
    """Masking field: exponent scale and offset, weights of the four smallest neighbours."""

    mul: float
    add: float
    erosion: tuple[float, float, float, float]


def field_params(distance: float) -> FieldParams:
    scale = 0.725 / distance
    dampen = 1.0 if distance < 2 else max(0.0, 1 - (distance - 2) / 12)
    soft = (2 - distance) * 0.5 if distance < 2 else 0.0
    raw = np.array([0.125, 0.10 * (1 - soft), 0.09 * (1 - soft), 0.06 * (1 - soft)])
    return FieldParams(scale * dampen, (1 - dampen) * 0.48 * scale, tuple((raw * (0.29959705784054957 / raw.sum())).tolist()))
