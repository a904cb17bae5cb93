from gatewatch.functions.scalar import (clamp, half_up, percent, safe_ratio,
                                        unusual_hour, coerce_double)
from gatewatch.functions.noise import (uniform, laplace_noise, gaussian_noise,
                                       std_normal, gaussian_sigma, noisy_display)
