"""From rules to DataFrame plans and fixpoints."""
