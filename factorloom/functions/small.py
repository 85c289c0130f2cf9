"""Matrices as small as the number of components, on the driver."""

from __future__ import annotations

import numpy as np


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric matrix; pseudo-inverse when it is singular."""
    try:
        return np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix, hermitian=True)


def symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2.0


def whitener(gram: np.ndarray, cutoff: float = 1e-13) -> np.ndarray:
    """``T`` such that ``Z·T`` has orthonormal columns, given ``gram = ZᵀZ``.

    The inverse Cholesky factor when it exists. ``ZᵀZ`` squares the condition number of ``Z``, so
    for a deficient ``Z`` the eigenvectors above ``cutoff`` are used and the rest become zero columns.
    """
    gram = symmetric(gram)
    values, vectors = np.linalg.eigh(gram)
    top = values[-1] if values.size else 0.0
    if top > 0 and values[0] > cutoff * top:
        return np.linalg.inv(np.linalg.cholesky(gram)).T
    keep = values > max(top, 0.0) * cutoff
    scale = np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    return (vectors * scale)[:, ::-1]


def eigen_desc(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first and not below zero, with their vectors."""
    values, vectors = np.linalg.eigh(symmetric(matrix))
    return np.maximum(values[::-1], 0.0), vectors[:, ::-1]


def inverse_sqrt(values: np.ndarray, cutoff: float = 1e-13) -> np.ndarray:
    """``1/√v``, zero where ``v`` is negligible."""
    top = values.max() if values.size else 0.0
    keep = values > cutoff * top
    return np.where(keep, 1.0 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
