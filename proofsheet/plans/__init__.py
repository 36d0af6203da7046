"""Driver-side plans over metadata only: analysis plans, question plans and
formula plans, each lowered to DataFrame calls."""
