"""Part of attestine; see the README for what lives here."""
