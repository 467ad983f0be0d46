"""Query plans over the operators, one module per family."""


def load() -> None:
    """Import every plan module, which registers its queries."""
    from arborkit.plans import files, images, morphometry, rendering, scalars, similarity, skeletons, volumes  # noqa: F401
