"""Rules as DataFrame plans, and fixpoints over them."""
