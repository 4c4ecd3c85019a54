"""Driver-side plan hygiene: lineage cuts and fixpoint loops."""
