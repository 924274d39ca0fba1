"""DataFrame operators.  Import from the submodules, e.g.
``from parcelrisk.operators.match import flag_membership``."""
