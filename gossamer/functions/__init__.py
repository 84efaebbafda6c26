"""Part of gossamer; see the package README."""
